import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from martloom.llm import collocations as co
from martloom.llm.frames import table
from martloom.llm.merkle import Block, climbed, leaves, manifest, proved, siblings
from martloom.llm.queries import QUERIES
from martloom.llm.ranks import ranked
from martloom.llm.sharding import shard_of, sharded, write_shards
from martloom.session import scratch_path
from tests.llm import plain
from tests.llm.conftest import COLUMNS, story

SF = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def hit():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


def tampered(docs, levels=10):
    more = {"n_chars": F.col("n_chars") + 1}
    return proved(manifest(leaves(docs, changes=more, where=hit()), levels))


def as_dict(rows):
    return {r.id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows}


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_as_brute_force(docs, levels):
    rows = [tuple(r) for r in docs.select(*FIELDS).collect()]
    found = tampered(docs, levels).collect()
    assert as_dict(found) == plain.merkle(rows)
    assert {r.verified for r in found} == {True, False}


def test_manifest_of_several_blocks_and_many_trees(spark):
    rows = [(i, f"t{i}", None if i % 50 == 49 else f"l{i % 50}" if i % 3 else "hot", "s", i) for i in range(5000)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(7)
    assert as_dict(tampered(docs).collect()) == plain.merkle([(i, s, lang, n, t) for i, t, lang, s, n in rows])


def test_manifest_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select(*FIELDS).collect()]
    found = QUERIES["op11_merkle_manifest"](spark, SF)
    assert as_dict(found.withColumnRenamed("doc_id", "id").collect()) == plain.merkle(rows)


def test_manifest_of_odd_rows(odd, empty):
    found = tampered(odd).collect()
    assert sorted(str(r.id) for r in found) == sorted(str(r.doc_id) for r in odd.collect())
    assert len({r.root for r in found}) == 1
    own = {plain.merkle_leaf((r.doc_id, r.source, r.lang, r.n_chars, r.text)) for r in odd.collect()}
    assert {r.leaf for r in found} == own
    # A change to a null field is none.
    assert all(r.verified for r in found if r.id in (None, 5, 6) or zlib.crc32(str(r.id).encode()) % 7)
    assert tampered(empty).count() == 0


def test_manifest_of_one_row_and_of_a_very_long_text(spark):
    rows = [(3, "x" * 3_000_000, "en", "a", 3_000_000)]
    found = as_dict(tampered(spark.createDataFrame(rows, COLUMNS)).collect())
    assert found == plain.merkle([(3, "a", "en", 3_000_000, rows[0][1])])


def test_versions_share_all_but_the_ancestors():
    nodes = [plain.sha(str(i)) for i in range(21)]
    base = Block(nodes, 6)
    assert len(base.levels) == 7 and base.levels[6] == [base.root]
    for i in range(21):
        version = base.version(i, plain.sha("new"))
        assert [(level, index) for level, index, _ in version] == [(level, i >> level) for level in range(7)]
        whole = Block([*nodes[:i], plain.sha("new"), *nodes[i + 1 :]], 6)
        copied = {(level, index): node for level, index, node in version}
        for level, row in enumerate(whole.levels):
            assert row == [copied.get((level, j), base.levels[level][j]) for j in range(len(row))]
        assert climbed(nodes[i], base.path(i)) == base.root
        assert climbed(plain.sha("new"), base.path(i)) == whole.root
        assert len(siblings(base.path(i))) % 64 == 0


def test_positions_within_groups(spark):
    rows = [("a" if i % 3 else None, i % 40, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(9).cache()
    out = ranked(df, ["g"], ["k"]).collect()
    groups = defaultdict(list)
    for r in out:
        groups[r.g].append((r.pos, r.k))
    assert Counter((r.g, r.k, r.v) for r in out) == Counter(rows)
    for held in groups.values():
        held.sort()
        assert [p for p, _ in held] == list(range(len(held)))
        assert [k for _, k in held] == sorted(k for _, k in held)
    assert sorted(r.pos for r in ranked(df, [], ["v"]).collect()) == list(range(1000))
    assert ranked(df.limit(0), ["g"], ["k"]).count() == 0


def rows_of(df):
    return [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]


@pytest.mark.parametrize(("support", "shards", "bits", "k"), [(5, 3, 20, 50), (9, 4, 8, 10), (2, 1, 16, 2000)])
def test_collocations_as_brute_force(docs, support, shards, bits, k):
    short = docs.where("n_chars < 5000").repartition(6)
    rows = [tuple(r) for r in short.select("lang", "text").collect()]
    found = co.collocations(co.mine(short, support, shards=shards, bits=bits), k)
    expected = plain.phrases(rows, support, k)
    assert expected and sorted(rows_of(found)) == sorted(expected)


def test_mined_counts_are_whole(docs, texts):
    """Also of very long texts: every phrase of the support, none missed by any shard."""
    mined = co.mine(docs, 30, shards=5)
    counts = defaultdict(Counter)
    for i, text in texts.items():
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", plain.lowered(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            counts["en" if i % 2 else "fr"].update(" ".join(w[j : j + m]) for m in range(1, 6) for j in range(len(w) - m + 1))
    expected = {(lang, p): n for lang, c in counts.items() for p, n in c.items() if n >= 30}
    assert {(r.lang, r.phrase): r.n for r in mined.counts.collect()} == expected


def test_words_across_chunks(monkeypatch):
    import random

    rng = random.Random(5)
    text = plain.lowered(" ".join([story(rng, 400), "y" * 700, "a.b,,c  d\t e\n", story(rng, 300)])).encode()
    whole = co.words_of(text)
    monkeypatch.setattr(co, "CHUNK", 64)
    parts = co.words_of(text)
    assert [text[a:b] for a, b in zip(parts.start, parts.end)] == re.findall(rb"[^ \t.,;:!?\n\x0b\x0c\r]+", text)
    for a, b in ((whole.start, parts.start), (whole.end, parts.end), (whole.hashes[0], parts.hashes[0])):
        assert np.array_equal(a, b)
    assert np.array_equal(np.diff(whole.piece) > 0, np.diff(parts.piece) > 0)
    assert len(co.words_of(b"").start) == len(co.words_of(b" .\n").start) == 0


def test_collocations_of_odd_rows(odd, empty):
    rows = [tuple(r) for r in odd.select("lang", "text").collect()]
    found = co.collocations(co.mine(odd, 2))
    assert sorted(rows_of(found)) == sorted(plain.phrases(rows, 2, 2000))
    assert "und" in {r.lang for r in found.collect()} or not [1 for r in plain.phrases(rows, 2, 9) if r[0] == "und"]
    assert co.collocations(co.mine(empty)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    counts = [("en", 1, "a", big), ("en", 1, "b", big - 7), ("en", 2, "a b", big - 9)]
    mined = co.Mined(
        spark.createDataFrame(counts, co.PHRASES), spark.createDataFrame([("en", 3 * big)], "lang string, n bigint")
    )
    (row,) = co.collocations(mined).collect()
    assert row.score == 1000 * (big - 9) * 3 * big // (big * (big - 7))


def test_shards_as_brute_force(docs, texts):
    weights = [1.0] * 24
    found = sharded(docs, weights, grown=1.0).collect()
    assert len(found) == len(texts)
    for r in found:
        data = texts[r.id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        assert r.shard == plain.rendezvous(r.id, weights) and r.grown_shard == plain.rendezvous(r.id, [1.0] * 25)
        assert r.grown_shard in (r.shard, 24)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_by_weight_move_few_keys(spark):
    keys = spark.range(20_000)
    shares = [1.0, 2.0, 5.0, 0.5]
    count = Counter(r.s for r in keys.select(shard_of(F.col("id"), shares).alias("s")).collect())
    for s, w in enumerate(shares):
        p = w / sum(shares)
        assert abs(count[s] - 20_000 * p) < 5 * math.sqrt(20_000 * p * (1 - p))
    heavier = [1.0, 2.0, 6.0, 0.5]
    moved = keys.select(shard_of(F.col("id"), shares).alias("a"), shard_of(F.col("id"), heavier).alias("b")).where("a <> b")
    assert {r.b for r in moved.collect()} == {2}
    fewer = keys.select(shard_of(F.col("id"), shares).alias("a"), shard_of(F.col("id"), shares[:3]).alias("b")).where("a <> b")
    assert {r.a for r in fewer.collect()} == {3}
    with pytest.raises(ValueError, match="above 0"):
        shard_of(F.col("id"), [1.0, 0.0])


def test_shards_of_odd_rows(odd, empty, spark):
    found = sharded(odd, [1.0, 1.0, 3.0]).collect()
    assert sorted((str(r.id), r.size) for r in found) == sorted(
        (str(r.doc_id), len((r.text or "").encode()) + 8) for r in odd.collect()
    )
    assert all(r.grown_shard is None and r.shard == plain.rendezvous(r.id, [1.0, 1.0, 3.0]) for r in found)
    assert sorted((r.shard, r.slot) for r in found) == sorted({(r.shard, r.slot) for r in found})
    assert sharded(empty, [1.0]).count() == 0
    long = spark.createDataFrame([(1, "é" * 2_000_000, "en", "a", 1)], COLUMNS)
    assert sharded(long, [1.0]).first().size == 4_000_008


def test_written_shards(docs, spark):
    path = scratch_path(spark, "shards")
    write_shards(docs, [1.0] * 5, path)
    back = spark.read.parquet(path)
    assert Counter(tuple(r) for r in back.select(*docs.columns).collect()) == Counter(tuple(r) for r in docs.collect())
    assert all(r.shard == plain.rendezvous(r.doc_id, [1.0] * 5) for r in back.collect())
