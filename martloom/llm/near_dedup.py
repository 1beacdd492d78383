"""Near-duplicate documents by bottom-k sketches, confirmed on full shingle sets.

One hash function maps a document's word shingles to 64 bits; its sketch is the `k`
smallest. Documents with equal sets are one class and only classes are compared.

*Candidates.* Inverted lists of the retained values give the overlaps. A linked pair shares
many sketch values, so some shared value must be among the rarest ones of each sketch; only
those are listed (a prefix filter on the sketch). Values that a common passage puts into
very many documents are thereby listed only for documents that consist of such passages.

*Rounds.* A list is never turned into all its pairs. In each round it names a few leaders,
from its smallest components and those first that share most values with others, and pairs
them with the members of other components; links found merge components, tested leaders
leave the list, and a list that lies in one component is done. A large group of near copies
is settled by its first leader. What is then still open is bounded exactly: a shingle that
no other open document has is in no intersection, and of the shingles in a hash bucket two
documents share no more than the one with fewer has there. So heavily edited copies are told
apart without being compared. The number of leaders grows `LEADERS_GROW`-fold each
round, and rounds go on until no list is open, so there is no cap on a list.

*Filter and proof.* The Jaccard index estimated on the smallest `k` values of the union of
both sketches drops pairs far below the threshold (4.5 standard deviations), the rest is
decided exactly on the full sets.

Sketches may miss a link with a probability of about 1e-5 for a pair right at the threshold,
less above it, and only if no other path joins the pair; what is reported is always exact.

Defined results: null, empty or blank texts have no shingles and are linked with nothing; a
text of fewer than `words` words is one shingle; rows with a null id form no group, have a
null component and are kept; rows that repeat an id are the same document.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.components import components
from martloom.llm.frames import Scratch, column, map_batches, map_stream, packed, slices
from martloom.session import cut

WORDS = 5
PERCENT = 75
SKETCH = 128
BUCKETS = 64
# Standard deviations that the sketch filters leave below the threshold.
MARGIN = 4.5
LEADERS_GROW = 256


class Shingler:
    """Sorted different 64-bit shingle hashes of texts; words met before are not hashed again."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.known = words, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(words) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words))], dtype=np.uint64)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = len(hashes) - self.words + 1
        mixed = np.zeros(n, dtype=np.uint64)
        for i in range(self.words):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        return np.unique(mixed ^ (mixed >> np.uint64(32)))


def sketches(rows: DataFrame, words: int, k: int) -> DataFrame:
    """(id, n, class, sketch) of a packed table; the class is a hash of the whole set."""

    def sketch(parts: Iterable[pa.RecordBatch]) -> Iterable[dict]:
        shingles = Shingler(words)
        for batch in slices(parts, "text", 1 << 23):
            sets = [shingles(text) for text in batch.column("text").to_pylist()]
            low = [s[:k].view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, low)])
            yield {
                "id": batch.column("id"),
                "n": [len(s) for s in sets],
                "class": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "sketch": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(low))),
            }

    return map_stream(rows.select("id", "text"), "id bigint, n bigint, class binary, sketch array<bigint>", sketch)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
    k: int = SKETCH,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): the group of each row and whether it leads it."""
    rows = packed(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "near")
    signed = scratch.write(sketches(rows, words, k), "sketches")
    grouped = signed.where("n > 0 and id is not null").groupBy("class")
    grouped = grouped.agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.write(grouped, "classes")
    of_class = cut(signed.select("id", "n", "class"), "members")
    scratch.give_up(signed)
    listed = cut(inverted_lists(classes, percent, k), "lists")
    members = listed.select(F.col("rep").alias("id")).distinct()
    sets = cut(shingle_sets(rows.join(members, "id", "left_semi"), words), "sets")
    labels = _merge(listed, classes, sets, percent, k)
    own = of_class.join(classes.select("class", "rep"), "class", "left")
    own = own.join(labels, "rep", "left")
    group = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return own.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), group.alias("component_id"),
        F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
    k: int = SKETCH,
) -> DataFrame:
    """`docs` with the first document of each group only."""
    found = near_duplicates(docs, id_col, text_col, words, percent, k)
    gone = found.where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, column(docs, id_col) == F.col("__gone"), "left_anti")


def inverted_lists(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """(v, rep, n, common): the values under which each class is listed, those of two classes or more.

    `common` is how many values of its sketch some other class has too. Of a sketch of s values a linked one shares at least share * s, so at least one shared
    value is among the s - share * s + 1 rarest.
    """
    share = max(0.0, percent / 100 - MARGIN * math.sqrt(percent / 100 * (1 - percent / 100) / k))
    values = classes.select("rep", F.explode("sketch").alias("v"))
    counts = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    common = values.join(counts, "v").groupBy("rep").agg(F.collect_list(F.struct("df", "v")).alias("common"))
    size = F.least(F.col("n"), F.lit(k))
    room = size - F.ceil(size * F.lit(share)) + 1 - (size - F.size("common"))
    listed = common.join(classes.select("rep", "n"), "rep").withColumn("room", room.cast("int")).where("room > 0")
    rarest = F.explode(F.slice(F.sort_array("common"), 1, F.col("room"))).alias("c")
    rows = listed.select("rep", "n", F.size("common").alias("common"), rarest)
    return rows.select(F.col("c.v").alias("v"), "rep", "n", "common").distinct()


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """(id, shingles): the full sets as bytes of sorted 64-bit hashes."""

    def sets(parts: Iterable[pa.RecordBatch]) -> Iterable[dict]:
        shingles = Shingler(words)
        for batch in slices(parts, "text", 1 << 23):
            found = [shingles(text).tobytes() for text in batch.column("text").to_pylist()]
            yield {"id": batch.column("id"), "shingles": found}

    return map_stream(rows.select("id", "text"), "id bigint, shingles binary", sets)


def _exploded(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, v): the shingles of the sets of `reps`."""

    def values(parts: Iterable[pa.RecordBatch]) -> Iterable[dict]:
        for batch in slices(parts, "shingles", 1 << 24):
            own = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column("shingles")]
            ids = np.repeat(batch.column("id").to_numpy(), [len(x) for x in own])
            yield {"rep": ids, "v": np.concatenate(own)}

    chosen = sets.join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    return map_stream(chosen, "rep bigint, v bigint", values)


def coverage(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, covered, spread): how many shingles another open set has too, in all and by hash bucket."""
    values = _exploded(sets, reps)
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v")
    bucket = F.pmod(F.col("v"), F.lit(BUCKETS))
    spread = F.array(*[F.count_if(bucket == b).cast("int") for b in range(BUCKETS)]).alias("spread")
    counts = values.join(shared, "v").groupBy("rep").agg(F.count("*").alias("covered"), spread)
    nothing = F.array_repeat(F.lit(0), BUCKETS)
    own = reps.select("rep").join(counts, "rep", "left").na.fill(0, ["covered"])
    return own.withColumn("spread", F.coalesce("spread", nothing))


def _merge(listed: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """(rep, component) of the listed classes, after rounds of leaders."""
    labels = cut(listed.select("rep").distinct().withColumn("component", F.col("rep")), "labels")
    signed = classes.select("rep", "sketch").join(labels.select("rep"), "rep", "left_semi")
    signed = cut(signed, "signed")
    # Until a set is known better, all of it may be shared.
    members = listed.withColumns({"covered": F.col("n"), "spread": F.lit(None).cast("array<int>")})
    tested, leaders = None, 1
    while True:
        now = cut(_open(members.join(labels, "rep"), percent), "members")
        if now.isEmpty():
            return labels
        if leaders == LEADERS_GROW:
            known = cut(coverage(sets, now.select("rep").distinct()), "coverage")
            now = cut(_open(now.drop("covered", "spread").join(known, "rep"), percent), "members")
        sizes = now.groupBy("v", "component").agg(F.count("*").alias("size"))
        order = Window.partitionBy("v").orderBy("size", F.desc("common"), "rep")
        smallest = now.join(sizes, ["v", "component"]).withColumn("place", F.row_number().over(order))
        lead = smallest.where(F.col("place") <= leaders).select("v", "rep", "component", "n", "covered", "spread")
        lead = cut(lead, "leaders")
        pairs = _pairs(lead, now, percent)
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            tested = pairs if tested is None else tested.unionByName(pairs)
            links = verified(estimated(pairs, signed, percent, k), sets, percent)
            labels = _relabelled(labels, links)
        members = now.join(lead.select("v", "rep"), ["v", "rep"], "left_anti").drop("component")
        leaders *= LEADERS_GROW


def _open(members: DataFrame, percent: int) -> DataFrame:
    """Members that may still be linked with one of another component in their list.

    A link needs a shared part of percent / (100 + percent) of both sizes together, and the
    smallest set of the list is the easiest partner.
    """
    lows = members.groupBy("v").agg(F.min("n").alias("low"))
    able = members.join(lows, "v").where((100 + percent) * F.col("covered") >= percent * (F.col("n") + F.col("low")))
    able = able.drop("low")
    parts = able.groupBy("v").agg(F.min("component").alias("one"), F.max("component").alias("other"))
    return able.join(parts.where("one <> other").select("v"), "v")


def _pairs(lead: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Different pairs (a, b), a < b, of a leader and a member of another component.

    Left out are pairs whose sizes, or the parts they can share at most, rule out a link.
    """
    names = ["rep", "component", "n", "covered", "spread"]
    other = members.select("v", *[F.col(c).alias(f"{c}_b") for c in names])
    need = percent * (F.col("n") + F.col("n_b"))
    lower = F.zip_with("spread", "spread_b", lambda x, y: F.least(x, y))
    most = F.aggregate(lower, F.lit(0), lambda total, x: total + x)
    met = other.join(lead, "v").where(
        (F.col("component") != F.col("component_b"))
        & (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))
        & ((100 + percent) * F.least("covered", "covered_b") >= need)
        & (F.col("spread").isNull() | F.col("spread_b").isNull() | ((100 + percent) * most >= need))
    )
    return met.select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b")).distinct()


def estimated(pairs: DataFrame, signed: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs whose union sketch does not rule out a link."""
    level = percent / 100 - MARGIN * math.sqrt(percent / 100 * (1 - percent / 100) / k)
    left = signed.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a"))
    right = signed.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(right, "b").join(left, "a")

    def near(batch: pa.RecordBatch) -> dict:
        keep = []
        for x, y in zip(batch.column("sketch_a"), batch.column("sketch_b"), strict=True):
            p, q = (np.asarray(s.values).view(np.uint64) for s in (x, y))
            union = np.union1d(p, q)[:k]
            shared = np.intersect1d(p, q, assume_unique=True)
            keep.append(np.searchsorted(shared, union[-1], "right") >= level * len(union))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        return {"a": kept.column("a"), "b": kept.column("b")}

    return map_batches(both.select("a", "b", "sketch_a", "sketch_b"), "a bigint, b bigint", near)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have a Jaccard index of `percent` or more."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(right, "b").join(left, "a")

    def confirm(parts: Iterable[pa.RecordBatch]) -> Iterable[dict]:
        for batch in slices(parts, "set_b", 1 << 25):
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                p, q = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                n = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * n >= percent * (len(p) + len(q) - n))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield {"a": kept.column("a"), "b": kept.column("b")}

    return map_stream(both.select("a", "b", "set_a", "set_b"), "a bigint, b bigint", confirm)


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components merged along the links; the label is the smallest id."""
    of_a = labels.select(F.col("rep").alias("a"), F.col("component").alias("ca"))
    of_b = labels.select(F.col("rep").alias("b"), F.col("component").alias("cb"))
    joined = links.join(of_a, "a").join(of_b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = components(joined).withColumnRenamed("node", "component")
    merged = labels.join(roots, "component", "left")
    return cut(merged.select("rep", F.coalesce("root", "component").alias("component")), "labels")
