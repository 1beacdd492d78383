"""Aggregation of child rows to one row per key."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.functions.values import col, is_numeric, present_sql, quoted
from martloom.operators.narrowing import fit_new_columns
from martloom.operators.plan import Identity, Plan
from martloom.session import cut

FUNCTIONS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


@dataclass(frozen=True)
class AggregatePlan:
    """Row count and the statistics per key; every other column is dropped."""

    key: str
    columns: tuple[str, ...]
    stats: tuple[str, ...] = ("mean", "std")
    types: Plan = Identity()

    def apply(self, df: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in df.schema.fields}
        aggs = [F.count(F.lit(1)).alias("len")]
        for k in self.stats:
            aggs += [
                F.expr(f"{FUNCTIONS[k]}({present_sql(c, types[c])}) as {quoted(f'{k}_{c}')}") for c in self.columns
            ]
        return self.types.apply(df.groupBy(col(self.key)).agg(*aggs))


@dataclass(frozen=True)
class Aggregate:
    """Chain stage: aggregate by key unless the key is already unique.

    Every numeric column that is neither key nor ignored is aggregated.
    """

    key: str
    ignore: tuple[str, ...] = ()
    stats: tuple[str, ...] = ("mean", "std")

    def plan(self, df: DataFrame) -> AggregatePlan:
        """The aggregation itself, without the check of the key and the type narrowing."""
        skip = {self.key, *self.ignore}
        numeric = [f.name for f in df.schema.fields if f.name not in skip and is_numeric(f.dataType)]
        return AggregatePlan(self.key, tuple(numeric), self.stats)

    def fit_apply(self, df: DataFrame) -> tuple[Plan, DataFrame]:
        """The plan and the aggregated table with narrowed new columns.

        Whether a key (null being one) repeats is counted over the keys alone where a sketch
        finds about as many keys as rows. Else the aggregate is written once, and that check,
        the statistics and the result read the written table instead of grouping the rows again.
        """
        seen = df.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(col(self.key)).alias("keys")).first()
        if seen["keys"] * 2 > seen["n"] and not repeats(df, self.key):
            return Identity(), df
        plan = self.plan(df)
        table = cut(plan.apply(df), "aggregate")
        if (table.agg(F.max("len").alias("most")).first()["most"] or 0) <= 1:
            return Identity(), df
        types = fit_new_columns(table, df.columns)
        return replace(plan, types=types), types.apply(table)

    def fit(self, df: DataFrame) -> Plan:
        return self.fit_apply(df)[0]


def repeats(df: DataFrame, key: str) -> bool:
    """Whether any key, null being one, has more than one row; only the keys are shuffled."""
    counts = df.groupBy(col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return (counts.agg(F.max("n").alias("most")).first()["most"] or 0) > 1


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(col(label).alias(label)).agg(F.count(F.lit(1)).alias("n"))
