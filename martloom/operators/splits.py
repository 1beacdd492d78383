"""Seeded splits, folds and samples with exact sizes, without sorting the table.

Rows are ordered by a uniform hash of their key. A split is then a set of cut points in
that order. Counting rows per hash bucket finds the bucket each cut falls in; only these
buckets are ranked to find the exact cut. Applying a split compares each row's hash with
the cuts, so nothing is shuffled, and a stratum holding most rows stays spread out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from martloom.functions.hashing import order_hash, order_text
from martloom.functions.values import col
from martloom.session import cut, written_side

BUCKET_DIGITS = 4  # leading hex digits that make a bucket: at most 16^4 per stratum
SEED = 42  # fixed value


@dataclass(frozen=True)
class CutPlan:
    """Cut points per stratum. A row's piece is the number of cuts it lies beyond.

    `cuts` has one row per stratum: s_0.. and the arrays `hashes`, `keys` with the last
    (hash, key) of every piece but the last. Without strata it is literal.
    """

    key: str
    seed: int
    strata: tuple[str, ...]
    cuts: DataFrame
    literal: tuple[tuple[str, object], ...] | None
    pieces: int

    def _beyond(self, h: Column, k: Column) -> Column:
        total = F.lit(0)
        for i in range(self.pieces - 1):
            if self.literal is not None:
                ch, ck = (F.lit(v) for v in self.literal[i])
            else:
                # A stratum without any cut has no row here: all its rows lie beyond.
                ch, ck = F.coalesce(F.col("__hashes")[i], F.lit("")), F.col("__keys")[i]
            total = total + F.when((h > ch) | ((h == ch) & (k > ck)), 1).otherwise(0)
        return total

    def apply(self, df: DataFrame, name: str = "piece") -> DataFrame:
        """Add the piece number of every row."""
        h, k = order_text(col(self.key), self.seed), col(self.key)
        if self.literal is not None:
            return df.withColumn(name, self._beyond(h, k))
        cuts = self.cuts.withColumnsRenamed({"hashes": "__hashes", "keys": "__keys"})
        on = [col(s).eqNullSafe(F.col(f"__s{i}")) for i, s in enumerate(self.strata)]
        cuts = cuts.withColumnsRenamed({f"s_{i}": f"__s{i}" for i in range(len(self.strata))})
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        joined = df.join(cuts, condition, "left").withColumn(name, self._beyond(h, k))
        return joined.select(*[col(c) for c in df.columns if c != name], name)


def fit_cuts(
    df: DataFrame, key: str, targets: Callable[[Column], list[Column]], strata: tuple[str, ...] = (), seed: int = SEED
) -> CutPlan:
    """Learn the cuts at the given cumulative row counts.

    `targets` maps a stratum's row count to the counts after which each piece ends, the
    last piece left out. Rows of one key stay together, so the counts are exact where the
    key is unique within a stratum, and else met up to the rows of the key at the cut.
    """
    names = [f"s_{i}" for i in range(len(strata))]
    rows = df.select(
        *[col(s).alias(n) for s, n in zip(strata, names)],
        col(key).alias("k"),
        order_text(col(key), seed).alias("h"),
    ).withColumn("b", F.substring("h", 1, BUCKET_DIGITS))
    in_order = W.partitionBy(*names).orderBy("b") if names else W.orderBy("b")
    whole = W.partitionBy(*names) if names else W.partitionBy()
    # At most 16^4 rows per stratum reach these windows.
    counts = (
        rows.groupBy(*names, "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("total", F.sum("n").over(whole))
    )
    ends = targets(F.col("total"))
    wanted = counts.select("*", F.posexplode(F.array(*[e.cast("bigint") for e in ends])).alias("piece", "target"))
    hit = (F.col("target") > F.col("upto") - F.col("n")) & (F.col("target") <= F.col("upto"))
    edges = wanted.where(hit).select(
        *names, "b", "piece", (F.col("target") - F.col("upto") + F.col("n")).alias("rest")
    )
    edges = written_side(edges, "edges")
    on = rows["b"] == edges["b"]
    for n in names:
        on = on & rows[n].eqNullSafe(edges[n])
    # Keys are counted before the window, so a key with many rows is one row in it.
    near = (
        rows.join(edges, on)
        .groupBy(*[rows[n] for n in names], "piece", "rest", "h", "k")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    running = W.partitionBy(*names, "piece").orderBy("h", "k").rowsBetween(W.unboundedPreceding, 0)
    found = near.withColumn("upto", F.sum("m").over(running)).where(
        (F.col("rest") > F.col("upto") - F.col("m")) & (F.col("rest") <= F.col("upto"))
    )
    pieces = len(ends) + 1
    # A piece that ends before the first row has no edge; its cut lies below every hash.
    hashes = [F.coalesce(F.max(F.when(F.col("piece") == i, F.col("h"))), F.lit("")) for i in range(pieces - 1)]
    keys = [F.max(F.when(F.col("piece") == i, F.col("k"))) for i in range(pieces - 1)]
    if not names:
        row = found.agg(F.array(*hashes).alias("hashes"), F.array(*keys).alias("keys")).first()
        return CutPlan(key, seed, (), None, tuple(zip(row["hashes"], row["keys"])), pieces)
    cuts = found.groupBy(*names).agg(F.array(*hashes).alias("hashes"), F.array(*keys).alias("keys"))
    return CutPlan(key, seed, strata, written_side(cuts, "cuts"), None, pieces)


def hash_bucket(key: str, buckets: int, seed: int = SEED) -> Column:
    """Bucket 0..buckets-1 of a key: one expression, sizes only near equal."""
    return F.pmod(order_hash(col(key), seed), F.lit(buckets)).cast("int")


def parse_ratio(ratio: str) -> tuple[int, int, int]:
    """Tenths for train, validation and test from a text such as "6:2:2"."""
    train, val, test = (int(v) for v in ratio.split(":"))
    return train, val, test


def _named(df: DataFrame, piece: str, names: tuple[str, ...], name: str) -> DataFrame:
    label = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        label = F.when(F.col(piece) == i, F.lit(names[i])).otherwise(label)
    return df.withColumn(name, label).drop(piece)


SETS = ("train", "valid", "test")


def ratio_split(
    df: DataFrame, ratio: str, key: str, stratify: str | None = None, seed: int = SEED, exact: bool = True
) -> DataFrame:
    """Add `split`; held-out rows number ceil(n * (val + test)) of every stratum.

    `exact=False` compares one hash bucket with the ratio: no job, sizes near the ratio.
    """
    _, val, test = parse_ratio(ratio)
    if not exact:
        b = hash_bucket(key, 10, seed)
        held = F.when(b < 10 - test, "valid").otherwise("test")
        return df.withColumn("split", F.when(b < 10 - val - test, "train").otherwise(held))

    def ends(n: Column) -> list[Column]:
        held = F.ceil(n * F.lit(val + test) / F.lit(10))
        tested = F.ceil(held * F.lit(test) / F.lit(val + test))
        return [n - held, n - tested]

    plan = fit_cuts(df, key, ends, (stratify,) if stratify else (), seed)
    return _named(plan.apply(df, "__piece"), "__piece", SETS, "split")


def group_split(df: DataFrame, key: str, seed: int = 1, exact: bool = True) -> DataFrame:
    """60/20/20 over distinct keys; all rows of a key share a set."""
    if not exact:
        b = hash_bucket(key, 10, seed)
        return df.withColumn("split", F.when(b < 6, "train").when(b < 8, "valid").otherwise("test"))

    def ends(n: Column) -> list[Column]:
        train = F.floor(n * F.lit(6) / F.lit(10))
        return [train, train + F.floor((n - train) / F.lit(2))]

    # Written once, so the two passes over the keys do not both reduce the whole table.
    keys = cut(df.select(col(key)).distinct(), "keys")
    plan = fit_cuts(keys, key, ends, (), seed)
    return _named(plan.apply(df, "__piece"), "__piece", SETS, "split")


def stratified_sample(df: DataFrame, label: str, size: float, key: str, seed: int = SEED) -> DataFrame:
    """floor(count * size) rows of every label, without replacement."""
    plan = fit_cuts(df, key, lambda n: [F.floor(n * F.lit(float(size)))], (label,), seed)
    return plan.apply(df, "__piece").where("__piece = 0").drop("__piece")


def stratified_folds(df: DataFrame, label: str, k: int, key: str, seed: int = SEED) -> DataFrame:
    """Add `fold`: each fold gets floor or ceil of its share of every label."""
    plan = fit_cuts(df, key, lambda n: [F.floor(n * F.lit(i) / F.lit(k)) for i in range(1, k)], (label,), seed)
    return plan.apply(df, "fold")


def folds(df: DataFrame, k: int, key: str, seed: int = SEED, exact: bool = True) -> DataFrame:
    """Add `fold` without regard to labels."""
    if not exact:
        return df.withColumn("fold", hash_bucket(key, k, seed))
    plan = fit_cuts(df, key, lambda n: [F.floor(n * F.lit(i) / F.lit(k)) for i in range(1, k)], (), seed)
    return plan.apply(df, "fold")


def expanding_folds(df: DataFrame, period: str) -> DataFrame:
    """(fold, test_period, first_period): fold i >= 1 trains on periods before the i-th."""
    # One row per period reaches the window.
    weeks = df.groupBy(col(period).alias("test_period")).agg(F.count(F.lit(1)).alias("n_test"))
    order = W.orderBy("test_period")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return (
        weeks.withColumn("fold", F.row_number().over(order) - 1)
        .withColumn("n_train", F.sum("n_test").over(before))
        .where("fold >= 1")
        .select("fold", "test_period", "n_train", "n_test")
    )


def shuffled(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """Seeded order of the keys (a range-partitioned sort)."""
    return df.orderBy(order_text(col(key), seed), col(key))


@dataclass(frozen=True)
class Ladder:
    """Row counts of the small, medium and full rung."""

    small: int
    medium: int
    full: int


SMALL_MB = 20  # fixed value


def ladder(n_rows: int, n_features: int, item_bytes: int = 2, limit_mb: float = SMALL_MB) -> Ladder:
    """Halve the feature matrix until it is within the limit; medium is the geometric mean.

    A matrix item has 2 bytes, as in half-precision features.
    """
    mb = n_rows * n_features * item_bytes / 1024**2
    coefficient = 1
    while mb / coefficient > limit_mb:
        coefficient *= 2
    small = n_rows // coefficient
    return Ladder(small, math.isqrt(n_rows * small), n_rows)


def ladder_sample(
    df: DataFrame, rung: str, label: str, key: str, n_features: int, limit_mb: float = SMALL_MB, seed: int = SEED
) -> DataFrame:
    """The stratified sample of one rung; the full rung is the table itself."""
    n = df.count()
    sizes = ladder(n, n_features, limit_mb=limit_mb)
    size = getattr(sizes, rung)
    return df if size == n else stratified_sample(df, label, size / n, key, seed)
