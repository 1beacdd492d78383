import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from martloom.llm.queries import QUERIES
from martloom.llm.sentence_pieces import Pieces, decode, default_model, encode, encode_and_check
from martloom.llm.token_rollup import TokenRollup, counted, default_versions
from martloom.session import scratch_path
from tests.llm import plain


def unigram(data: bytes) -> bytes:
    """A model file with its kind set to unigram: field 3 of the trainer part, field 2."""

    def number(i):
        x = shift = 0
        while True:
            b = data[i]
            x, shift, i = x | (b & 127) << shift, shift + 7, i + 1
            if b < 128:
                return x, i

    out, i = bytearray(data), 0
    while i < len(data):
        key, i = number(i)
        size, i = number(i)
        end = i + size
        while key >> 3 == 2 and i < end:
            inner, i = number(i)
            if inner & 7 == 0:
                start = i
                _, i = number(i)
                if inner >> 3 == 3:
                    out[start] = 1
            else:
                size, i = number(i) if inner & 7 == 2 else (4 if inner & 7 == 5 else 8, i)
                i += size
        i = end
    return bytes(out)


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_ids_are_those_of_the_library(kind, texts):
    from sentencepiece import SentencePieceProcessor

    data = open(default_model(), "rb").read()
    model = SentencePieceProcessor(model_proto=data if kind == "bpe" else unigram(data))
    pieces, rng = Pieces(default_model(), kind), random.Random(5)
    letters = "ab  é你\n\tT.,!the ing\U0001f600\x00'"
    some = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(2000)]
    # Beyond a few words the library sums scores in single precision, so only merging is compared on whole texts.
    some += list(texts.values()) if kind == "bpe" else []
    for text, ids in zip(some, pieces.encode(some), strict=True):
        own = np.frombuffer(ids, "<u4").tolist()
        assert own == model.encode(text)
        assert pieces.decode(own) == text


def test_pieces_round_trip(docs, texts, odd, empty):
    assert {r.doc_id: r.text for r in decode(encode(docs)).collect()} == texts
    assert all(r.round_trip for r in encode_and_check(docs).collect())
    assert len(encode_and_check(odd).collect()) == odd.count()
    assert encode(empty).count() == encode_and_check(empty).count() == 0


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, seq long, doc_id long, text string, source string, lang string")


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_rollup_follows_inserts_revisions_and_deletes(spark):
    rng, versions = random.Random(1), {"words": default_versions()["words"]}
    rollup, live = TokenRollup(spark, scratch_path(spark, "rollup")), {}
    for batch in range(5):
        rows = []
        for seq in range(30):
            op, i = rng.choice(["insert", "insert", "revise", "delete"]), rng.randrange(25)
            own = (" ".join("w" * rng.randrange(9)), rng.choice(["a", None]), rng.choice(["en", "fr", None]))
            rows.append((op, seq, i, *own))
        for op, _, i, text, source, lang in rows:
            if op == "delete":
                live.pop(i, None)
            else:
                live[i] = (source, lang, len(text.split()))
        assert rollup.commit(f"b{batch}", counted(changes(spark, rows), versions))
        expected = {}
        for source, lang, n in live.values():
            docs, tokens = expected.get((source, lang, "words"), (0, 0))
            expected[source, lang, "words"] = (docs + 1, tokens + n)
        assert totals(rollup) == expected
    before = totals(rollup)
    assert not rollup.commit("b2", counted(changes(spark, rows), versions))
    assert totals(rollup) == before and rollup.batches() == [f"b{i}" for i in range(5)]


def test_a_batch_cut_off_before_its_commit_does_not_count(spark):
    versions, root = {"words": default_versions()["words"]}, scratch_path(spark, "rollup")
    rollup = TokenRollup(spark, root)
    rows = counted(changes(spark, [("insert", 0, 1, "a b", "s", "en"), ("insert", 0, None, "c", "s", "en")]), versions)
    rollup._signed(rows).write.parquet(f"{root}/ledger/batch=x")
    assert totals(rollup) == {}
    rollup.commit("x", rows)
    assert totals(rollup) == {("s", "en", "words"): (2, 3)}


def test_rollup_of_odd_rows(spark, odd, empty):
    versions = default_versions()
    for df in (odd, empty):
        rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
        rows = df.withColumns({"op": F.lit("insert"), "seq": F.lit(0)})
        rollup.commit("all", counted(rows, versions))
        docs = len({r.doc_id for r in df.collect()} - {None}) + df.where("doc_id is null").count()
        assert sum(n for (_, _, version), (n, _) in totals(rollup).items() if version == "words") == docs


def test_token_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i].text, i)
    expected = {}
    for i, r in docs.items():
        if first[r.text] == i:
            text = "".join(c for c in r.text if c not in "0123456789")
            n, tokens = expected.get((r.source, r.lang), (0, 0))
            expected[r.source, r.lang] = (n + 1, tokens + len(text.encode().split()))
    rows = QUERIES["op10_token_counts"](spark, sf).where("version = 'words'").collect()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rows} == expected


def test_stages_keep_the_columns_and_their_decisions(spark, docs, texts):
    found, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, "").cache()
        assert found.columns == docs.columns
        assert all(r.n_chars == len(r.text) for r in found.collect())
        seen.append((name, {r.doc_id: r.text for r in found.collect()}))
    lettered = {i: t for i, t in texts.items() if any(c.isalpha() for c in t)}
    kept = seen[0][1]
    assert set(kept) <= set(lettered) and len(kept) >= len(lettered) - 3
    lines = {i: t for i, (_, _, t) in plain.without_lines(kept).items()}
    assert seen[1][1] == lines
    groups = plain.near_groups(lines)
    assert set(seen[2][1]) == set(groups.values())
    for i, text in seen[3][1].items():
        assert text == lines[i] if not plain.personal(lines[i]) else "[" in text
    assert not any(plain.personal(t) for t in seen[3][1].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, found, "")
    assert {r.doc_id for r in packed.collect()} == set(groups.values())


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, "").count()


def test_run_is_the_stages_one_after_another(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_stage_by_stage_against_a_plain_rerun(spark):
    """The first two decisions of the pipeline on driver documents, computed without Spark."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, "")
    kept = {r.doc_id: r.text for r in first.collect()}
    lines = {r.doc_id: r.text for r in corpus_pipeline.STAGES[1][1](spark, first, "").collect()}
    assert lines == {i: t for i, (_, _, t) in plain.without_lines(kept).items()}
    last = {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id").collect()}
    assert last == set(plain.near_groups(lines).values())
