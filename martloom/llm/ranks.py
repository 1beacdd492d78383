"""Gapless positions within groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.session import cut, written_side


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """`df` with `name`: 0, 1, 2, ... within each `group` by `order`, nulls first.

    Rows are range-partitioned by group and order and sorted there, so a large group spreads
    over many tasks; only one row per task and group is counted up. Rows equal in every key
    are told apart by their place in `df`, so that copies of one row are spread too; which of
    them comes first is left open. `df` should be a written table, as it is read twice.
    """
    keys = [*group, *order, "_place"]
    lined = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Partition number in the high bits, row number within the partition in the low 33.
    placed = cut(lined.drop("_place").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    starts = written_side(runs.select(*[F.col(c).alias(f"_{c}") for c in group], "_part", start.alias("_start")), "starts")
    same: Column = part == F.col("_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return placed.join(starts, same).select(*df.columns, (F.col("_at") + F.col("_start")).alias(name))
