"""Phrase collocations: frequent word sequences that hold together, by partitioned mining (SON).

1. Documents fall into a fixed number of shards (by partition, so a task mostly counts for one
   shard). A shard's local support for a language is the global one times the shard's part of
   that language's words, rounded up. A phrase of global support reaches it in at least one
   shard, as it would otherwise fall short in the sum.
2. Each shard is mined completely, length by length: a sequence is counted only where both its
   parts of one word less are locally frequent. The frequent ones of the last length are a bit
   set of fixed size; a shared bit lets a phrase through that need not be counted, but never
   keeps one out.
3. The locally frequent phrases of all shards are united: the candidates.
4. Every candidate is counted globally and exactly. In the shards where it was frequent its
   count is known already, so one pass over all texts counts the candidates of each shard that
   fell short there, and reads the words of each candidate once, in a partition that has it.

A shard may hold any number of documents: tasks sum up what they see, and Spark adds it up by
shard, language and hash. Bit sets (2**bits bits, 16 MB) are all that is broadcast; where more
phrases are frequent than they tell apart, more is counted and the result stays the same.
Phrases are told apart by 80 bits of hash from two bases until their words are read; only an
equal hash of a frequent phrase could change a count.

Every part of a phrase is at least as frequent as the phrase, so all counts that cuts and
longer phrases need are among the candidates. Scores are whole numbers of 38 digits.

Defined results: a null language is `und`, a null text has no words; languages without
candidates have no rows; repeated rows count each time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.frames import column, map_stream, slices
from martloom.session import cut, written_side

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# 0: part of a word, 1: between words, 2: between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2

SLICE = 1 << 20  # bytes of text worked on at once
CHUNK = 1 << 18  # bytes hashed at once; a longer word makes its chunk longer
HELD = 1 << 19  # sums a task holds before it sends them on
SENT = 1 << 16  # rows sent on at once
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that powers can be undone

SALT = 0x9E3779B1  # below 2**32, so that a number of 31 bits times it stays below 2**63

GRAMS = "part int, lang string, gram bigint, more smallint, n bigint"
READ = "part int, lang string, gram bigint, more smallint, n bigint, phrase string"
PHRASES = "lang string, m int, phrase string, n bigint"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


@dataclass
class Words:
    """The words of a text: where they are, in which piece, and their hashes for each base."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    hashes: list[np.ndarray]


def words_of(data: bytes, bases: tuple[int, ...] = BASES) -> Words:
    """`data` is lower-cased already; words are hashed chunk by chunk, cut where no word is."""
    every = np.frombuffer(data, np.uint8)
    starts, ends, pieces, hashes, piece, at = [], [], [], [[] for _ in bases], 0, 0
    while at < len(every):
        stop, size = len(every), CHUNK
        while at + size < len(every):
            gaps = np.flatnonzero(KIND[every[at + size // 2 : at + size]])
            if len(gaps):
                stop = at + size // 2 + int(gaps[-1]) + 1
                break
            size *= 2
        part = every[at:stop]
        kind = KIND[part]
        inside = np.concatenate(([0], (kind == 0).view(np.int8), [0]))
        edge = np.flatnonzero(np.diff(inside))
        s, e = edge[::2], edge[1::2]
        breaks = np.cumsum(kind == 2)
        for out, base in zip(hashes, bases, strict=True):
            power, inverse = _powers(base, max(CHUNK, 1 << (len(part) - 1).bit_length()) if len(part) > 1 else CHUNK)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
            out.append(mixed((sums[e] - sums[s]) * inverse[s]))
        starts.append(s + at)
        ends.append(e + at)
        pieces.append(breaks[s] + piece)
        piece += int(breaks[-1])
        at = stop
    none = [np.zeros(0, np.int64)]
    return Words(
        data, np.concatenate(starts or none), np.concatenate(ends or none), np.concatenate(pieces or none),
        [np.concatenate(h or [np.zeros(0, np.uint64)]) for h in hashes],
    )


def longer(grams: np.ndarray, words: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the m words from each place on, given those of m - 1 words."""
    n = max(len(words) - m + 1, 0)
    return mixed(grams[:n] * np.uint64(BASES[1]) ^ words[m - 1 :][:n])


def within(piece: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words from each place on are of one piece."""
    n = max(len(piece) - m + 1, 0)
    return piece[:n] == piece[m - 1 :][:n]


def salt(shard: np.ndarray) -> np.ndarray:
    """A number per shard (or partition) that moves its phrases to bits of its own."""
    return shard.astype(np.int64).view(np.uint64) * np.uint64(SALT)


def salt_column(shard: str) -> Column:
    return F.col(shard).cast("bigint") * F.lit(SALT)


class Bits:
    """A set of hashes as 2**bits bits, sent to the tasks."""

    def __init__(self, hashes: DataFrame, hash_: Column, bits: int) -> None:
        place = hash_.bitwiseAND(F.lit((1 << bits) - 1))
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
        rows = hashes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
        held = np.zeros(1 << (bits - 6), np.int64)
        held[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
        self.any, self.bits = bool(rows.num_rows), bits
        self.held: Broadcast = hashes.sparkSession.sparkContext.broadcast(held)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64((1 << self.bits) - 1)
        words = self.held.value.view(np.uint64)[place >> np.uint64(6)]
        return (words >> (place & np.uint64(63))) & np.uint64(1) == 1


@lru_cache(maxsize=100_000)
def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    """Slices with their texts joined by a break, and where each text begins."""
    for part in slices(batches, "text", SLICE):
        texts = part.column("text").to_pylist()
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        yield part, b"\n".join(texts).translate(LOWER), begin


class _Sums:
    """Counts by (key, more), sent on when too many are held; `code` is that of any of its rows."""

    def __init__(self) -> None:
        self.parts, self.rows = [], 0

    def add(self, key: np.ndarray, more: np.ndarray, code: np.ndarray, n: np.ndarray | None = None) -> None:
        # Rows of one key and another `more` than its first are kept apart, one by one.
        different, first, place, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        n = np.ones(len(key), np.int64) if n is None else n
        odd = more != more[first][place]
        total = np.bincount(place, np.where(odd, 0, n), len(different)).astype(np.int64)
        for part in ((different, more[first], code[first], total), (key[odd], more[odd], code[odd], n[odd])):
            if len(part[0]):
                self.parts.append(part)
                self.rows += len(part[0])

    def merged(self) -> tuple[np.ndarray, ...]:
        key, more, code, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.rows = [], 0
        self.add(key, more, code, n)
        return tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))

    def sent(self, codes: list[tuple[int, str, int]], last: bool) -> Iterator[dict]:
        """Rows (part, lang, gram, more, n) of all that is held, if it is too much or the last."""
        if not self.rows or not last and self.rows <= HELD:
            return
        keys, mores, all_codes, ns = self.merged()
        if not last and self.rows <= HELD // 2:
            return
        self.parts, self.rows = [], 0
        shard, part = (np.array([c[i] for c in codes], np.int32) for i in (0, 2))
        langs = pa.array([lang for _, lang, _ in codes])
        for at in range(0, len(keys), SENT):
            key, more, code, n = (x[at : at + SENT] for x in (keys, mores, all_codes, ns))
            yield {
                "part": part[code], "lang": langs.take(pa.array(code)),
                "gram": (key ^ salt(shard[code])).view(np.int64), "more": more.view(np.int16), "n": n,
            }


class _Grams:
    """The sequences of growing length in a slice of texts, each with its row's (shard, lang, part)."""

    def __init__(self, batch: pa.RecordBatch, data: bytes, begin: np.ndarray, codes: dict) -> None:
        rows = zip(*[batch.column(c).to_pylist() for c in ("shard", "lang", "part")], strict=True)
        own = np.array([codes.setdefault(r, len(codes)) for r in rows])
        self.words = words_of(data)
        self.code = own[np.searchsorted(begin, self.words.start, "right") - 1]
        names = list(codes)
        lang = np.array([_lang_hash(name) for _, name, _ in names], np.uint64)[self.code]
        self.shard = salt(np.array([s for s, _, _ in names]))[self.code]
        self.part = salt(np.array([p for _, _, p in names]))[self.code]
        self.m = 1
        self.first, self.second = (mixed(h ^ lang) for h in self.words.hashes)

    def next(self) -> None:
        self.m += 1
        self.first = longer(self.first, self.words.hashes[0], self.m)
        self.second = longer(self.second, self.words.hashes[1], self.m)

    def more(self) -> np.ndarray:
        return (self.second >> np.uint64(48)).astype(np.uint16)

    def local(self) -> np.ndarray:
        """The sequences as those of their shard."""
        return self.first ^ self.shard[: len(self.first)]


def by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """Counts added up by shard, language and hash; `part` is any partition that has the phrase."""
    own = F.pmod("part", F.lit(shards)).alias("shard")
    return rows.groupBy(own, "lang", "gram", "more").agg(F.sum("n").alias("n"), F.any_value("part").alias("part"))


def local_counts(texts: DataFrame, m: int, shards: int, before: Bits | None) -> DataFrame:
    """(shard, lang, gram, more, n, part): sequences of m words whose parts of m - 1 words `before` holds."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        codes: dict[tuple[int, str, int], int] = {}
        sums = _Sums()
        for batch, data, begin in _texts(batches):
            grams = _Grams(batch, data, begin, codes)
            while grams.m < m - 1:
                grams.next()
            good = within(grams.words.piece, m)
            if m > 1:
                known = before.has(grams.local())
                good &= known[: len(good)] & known[1 : len(good) + 1]
                grams.next()
            at = np.flatnonzero(good)
            if len(at):
                sums.add(grams.local()[at], grams.more()[at], grams.code[at])
            yield from sums.sent(list(codes), last=False)
        yield from sums.sent(list(codes), last=True)

    return by_shard(map_stream(texts, GRAMS, count), shards)


def read_again(texts: DataFrame, longest: int, short: Bits, named: Bits) -> DataFrame:
    """(part, lang, gram, more, n, phrase): counts of what `short` holds of a shard, and the words
    of what `named` holds of a partition."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        codes: dict[tuple[int, str, int], int] = {}
        sums, seen = _Sums(), set()
        for batch, data, begin in _texts(batches):
            grams = _Grams(batch, data, begin, codes)
            while grams.m <= longest:
                inside = within(grams.words.piece, grams.m)
                at = np.flatnonzero(short.has(grams.local()) & inside)
                if len(at):
                    sums.add(grams.local()[at], grams.more()[at], grams.code[at])
                at = np.flatnonzero(named.has(grams.first ^ grams.part[: len(grams.first)]) & inside)
                keys, more = grams.first.view(np.int64), grams.more().view(np.int16)
                found = {(int(keys[i]), int(more[i])): i for i in at}
                new = [k for k in found if k not in seen]
                seen.update(new)
                if new:
                    lines, names = [found[k] for k in new], list(codes)
                    start, end = grams.words.start, grams.words.end
                    yield {
                        "part": [None] * len(new), "lang": [names[grams.code[i]][1] for i in lines],
                        "gram": [k for k, _ in new], "more": [k for _, k in new], "n": [None] * len(new),
                        "phrase": [b" ".join(data[start[i] : end[i + grams.m - 1]].split()).decode("utf-8", "replace") for i in lines],
                    }
                grams.next()
            if len(seen) > HELD // 4:
                seen.clear()
            yield from (r | {"phrase": [None] * len(r["n"])} for r in sums.sent(list(codes), last=False))
        yield from (r | {"phrase": [None] * len(r["n"])} for r in sums.sent(list(codes), last=True))

    return map_stream(texts, READ, read)


@dataclass(frozen=True)
class Mined:
    """`counts` (lang, m, phrase, n) of all phrases of at least the support, `totals` (lang, n)."""

    counts: DataFrame
    totals: DataFrame


def mine(
    docs: DataFrame, support: int = 100, longest: int = 5, shards: int = 2, bits: int = 27,
    text: str = "text", lang: str = "lang",
) -> Mined:
    """All phrases of 1 to `longest` words that occur `support` times in a language."""
    part = F.spark_partition_id()
    texts = cut(
        docs.select(
            F.pmod(part, F.lit(shards)).alias("shard"),
            part.alias("part"),
            F.coalesce(column(docs, lang).cast("string"), F.lit("und")).alias("lang"),
            F.coalesce(column(docs, text), F.lit("")).cast("binary").alias("text"),
        ),
        "texts",
    )
    words = cut(local_counts(texts, 1, shards, None), "words")
    sizes = words.groupBy("shard", "lang").agg(F.sum("n").alias("own"))
    totals = cut(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    exact = "decimal(38,0)"
    # Rounded up: support * own / total.
    need = F.expr(f"(cast({support} as {exact}) * own + total - 1) div total")
    needs = sizes.join(totals.withColumnRenamed("n", "total"), "lang").select("shard", "lang", need.alias("need"))
    needs = written_side(needs, "needs")
    levels, counts, m = [], words, 1
    while True:
        frequent = counts.join(needs, ["shard", "lang"]).where("n >= need").drop("need").withColumn("m", F.lit(m))
        levels.append(frequent := cut(frequent, "frequent"))
        known = Bits(frequent, F.col("gram").bitwiseXOR(salt_column("shard")), bits) if m < longest else None
        if known is None or not known.any:
            break
        m += 1
        counts = local_counts(texts, m, shards, known)
    key = ["lang", "gram", "more"]
    candidates = reduce(DataFrame.unionByName, levels).groupBy(*key, "m").agg(
        F.sum("n").alias("n"), F.any_value("part").alias("part"), F.collect_set("shard").alias("held")
    )
    candidates = cut(candidates, "candidates")
    others = F.explode(F.array_except(F.sequence(F.lit(0), F.lit(shards - 1)), "held")).alias("shard")
    short = cut(candidates.select(*key, others), "short")
    again = read_again(
        texts, longest, Bits(short, F.col("gram").bitwiseXOR(salt_column("shard")), bits),
        Bits(candidates, F.col("gram").bitwiseXOR(salt_column("part")), bits),
    )
    again = cut(again, "again")
    # What shared a bit by chance is neither short nor a candidate and finds no partner here.
    rest = by_shard(again.where("n is not null"), shards)
    rest = rest.drop("part").join(short, ["shard", *key]).groupBy(*key).agg(F.sum("n").alias("rest"))
    phrases = again.where("phrase is not null").groupBy(*key).agg(F.max("phrase").alias("phrase"))
    whole = candidates.join(rest, key, "left").withColumn("n", F.col("n") + F.coalesce("rest", F.lit(0)))
    counts = whole.where(F.col("n") >= support).join(phrases, key).select("lang", "m", "phrase", "n")
    return Mined(cut(counts, "phrases"), totals)


def scored(mined: Mined) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate: its weakest cut."""
    counts, exact = mined.counts, "decimal(38,0)"
    cuts = counts.where("m > 1").select(
        "lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")
    )
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"),
    )
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(mined.totals, "lang")
    score = F.expr(f"(cast(1000 * cast(a as {exact}) as {exact}) * n) div (cast(l as {exact}) * r)")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    found = both.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), weakest)
    return found.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def inside_longer(mined: Mined, percent: int = 100) -> DataFrame:
    """(lang, phrase) of what a longer phrase holds that is at least `percent` as frequent.

    One more word is enough to look at: a longer phrase holds one of that length, which is as
    frequent at least.
    """
    longer = mined.counts.where("m > 2").select("lang", "m", "n", F.split("phrase", " ").alias("w"))
    ends = F.array(F.slice("w", 1, F.col("m") - 1), F.slice("w", 2, F.col("m") - 1))
    parts = longer.select("lang", F.explode(ends).alias("part"), "n")
    most = parts.select("lang", F.array_join("part", " ").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    return mined.counts.join(most, ["lang", "phrase"]).where(f"100 * most >= {percent} * n").select("lang", "phrase")


def collocations(mined: Mined, k: int = 2000, percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `k`."""
    left = scored(mined).join(inside_longer(mined, percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
