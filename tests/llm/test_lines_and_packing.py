import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from martloom.llm.line_dedup import AS_WRITTEN, LineIndex, drop_repeated_lines, line_hashes
from martloom.llm.frames import packed, setting
from martloom.llm.packing import bin_plan, default_vocabulary, fullest, pack, sequences, word_ids
from martloom.session import scratch_root
from tests.llm import plain


@pytest.mark.parametrize("batches", [1, 5])
def test_lines_as_brute_force(docs, texts, batches):
    out = drop_repeated_lines(docs, batches=batches).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out} == plain.without_lines(texts)


def test_lines_of_odd_rows(odd):
    out = drop_repeated_lines(odd, batches=3)
    assert out.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == odd.count()
    kept = sorted((r.doc_id or 0, r.text or "", r.n_dropped) for r in rows)
    same = "the same words come again and again in this one document of ours"
    assert kept == [
        (0, "", 0), (0, same, 0), (1, same, 0), (1, same, 0), (2, "", 1), (2, "two texts of one id only here", 0),
        (5, "", 0), (6, "", 0), (7, "une ligne\nune autre ligne ici\n", 0), (8, "", 1),
    ]
    assert all(r.id == "own id" and r.h == "own h" for r in rows)


def test_lines_of_an_empty_table(empty):
    assert drop_repeated_lines(empty).count() == 0


def test_line_index_compacts_its_runs(spark, docs):
    lines = line_hashes(packed(docs)).cache()
    index = LineIndex(spark, fan_in=2, buckets=4)
    seen: set = set()
    for n in range(5):
        batch = lines.where(F.pmod("id", F.lit(5)) == n)
        own = {bytes(r.h) for r in batch.collect()}
        dropped = {bytes(r.h) for r in index.add(batch).collect()}
        assert seen & own <= dropped
        seen |= own
        levels = [level for level, _ in index.runs]
        assert len(levels) == len(set(levels)), "each level holds fewer runs than are merged"
        for _, name in index.runs:
            files = spark.table(name).inputFiles()
            assert len(files) <= 4, "one file a bucket, also after merges"
            assert all(scratch_root(spark) in f for f in files), "runs lie in the shared folder"
            for f in files:
                own = [bytes(r.h) for r in spark.read.parquet(f).collect()]
                assert own == sorted(own)
    assert sum(spark.table(name).count() for _, name in index.runs) == len(seen)
    index.drop()
    assert not index.runs


def test_line_runs_are_merged_as_they_lie(spark, docs):
    lines = line_hashes(packed(docs)).cache()
    index = LineIndex(spark, fan_in=3, buckets=4)
    for n in range(2):
        index.add(lines.where(F.pmod("id", F.lit(2)) == n))
    with setting(spark, *AS_WRITTEN):
        plan = index._merged([name for _, name in index.runs])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Exchange" not in plan and "Sort [" not in plan
    index.drop()
    assert spark.conf.get(AS_WRITTEN[0]) == "false"


def encoded(texts):
    tokenizer = word_ids(default_vocabulary()).tokenizer
    return {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()}


def test_packing_is_whole_and_tight(docs, texts):
    rows = pack(docs).collect()
    ids, total = encoded(texts), 0
    found = {(r.doc_id, r.piece): r for r in rows}
    for i, own in ids.items():
        for n, start in enumerate(range(0, len(own), 4096)):
            r, part = found.pop((i, n)), own[start : start + 4096]
            assert (r.start, r.length, r.ids_crc32) == (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            total += len(part)
    assert not found
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) == -(-total // 4096)


def test_sequences_hold_the_ids(docs, texts):
    placed = pack(docs, capacity=512)
    out = {r.sequence_id: r.ids for r in sequences(docs, placed, capacity=512).collect()}
    ids = encoded(texts)
    for r in placed.collect():
        assert out[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length]


def test_packing_of_odd_rows(odd, empty):
    rows = pack(odd).collect()
    assert len(rows) == odd.count() and sorted(r.length for r in rows)[:3] == [1, 1, 1]
    assert pack(empty).count() == 0


def test_bins_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        histogram = {rng.randint(1, 60): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        slots, bins = bin_plan(histogram, 60)
        filled, used = {}, dict.fromkeys(histogram, 0)
        for s in slots:
            assert s.first == used[s.length]
            nexts = [t.first for t in slots if t.length == s.length and t.first > s.first]
            last = min([*nexts, histogram[s.length]])
            for rank in range(s.first, last):
                turn, spot = divmod(rank - s.first, s.each)
                filled.setdefault(s.bin + turn, []).append((s.offset + spot * s.length, s.length))
            used[s.length] = last
        assert used == histogram and len(filled) == bins
        for members in filled.values():
            end = 0
            for offset, length in sorted(members):
                assert offset == end
                end += length
            assert end <= 60


def test_fullest_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        items = sorted({rng.randint(1, 25): rng.randint(1, 4) for _ in range(4)}.items(), reverse=True)
        room, sums = rng.randint(0, 60), {0}
        for length, n in items:
            sums = {s + k * length for s in sums for k in range(n + 1)}
        got = fullest(items, room)
        assert sum(got) == max(s for s in sums if s <= room)
        assert all(got.count(length) <= n for length, n in items)


def test_words_have_the_ids_of_the_tokenizer():
    words, rng = word_ids(default_vocabulary()), random.Random(5)
    letters = "abcXYZéÉïŒœßñ'-.,!?0123456789sSTtdDmMlLrReEvV<>|你́İ _&\n"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|> x<|startoftext|>Y", "a. b, c.\nd .. e!. f", "é. ×. ÷, ."]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
