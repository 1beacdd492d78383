"""Standard scaling with remembered statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from martloom.functions.values import col, is_numeric, present_sql, quoted, standard_sql, unstandard
from martloom.operators.profile import batched


@dataclass(frozen=True)
class ScalePlan:
    """(column, mean, std) per scaled column."""

    stats: tuple[tuple[str, float | None, float | None], ...]

    def apply(self, df: DataFrame) -> DataFrame:
        """Scale the remembered columns that are still there."""
        known = {c: (mean, std) for c, mean, std in self.stats}
        return df.selectExpr(
            *[
                f"{standard_sql(present_sql(f.name, f.dataType), *known[f.name])} as {quoted(f.name)}"
                if f.name in known
                else quoted(f.name)
                for f in df.schema.fields
            ]
        )

    def inverse(self, value: Column, column: str) -> Column:
        """Undo the scaling of `column` for a value, such as a prediction of it."""
        mean, std = next((m, s) for c, m, s in self.stats if c == column)
        return unstandard(value, mean, std)


@dataclass(frozen=True)
class Scale:
    """Chain stage: scale every numeric column that is not ignored.

    `sample=False` divides by the population deviation (1 where it is 0); `sample=True`
    is the plain z-score, null where the deviation is 0 or undefined.
    """

    ignore: tuple[str, ...] = ()
    sample: bool = False

    def fit(self, df: DataFrame) -> ScalePlan:
        fields = [f for f in df.schema.fields if f.name not in self.ignore and is_numeric(f.dataType)]
        deviation = "stddev_samp" if self.sample else "stddev_pop"
        if not fields:
            return ScalePlan(())
        aggs = []
        for i, f in enumerate(fields):
            c = f"cast({present_sql(f.name, f.dataType)} as double)"
            aggs.append([f"avg({c}) as m{i}", f"{deviation}({c}) as s{i}"])
        row = batched(df, aggs)
        stats = []
        for i, f in enumerate(fields):
            mean, std = row[f"m{i}"], row[f"s{i}"]
            if self.sample and not std:
                mean = None
            stats.append((f.name, mean, std))
        return ScalePlan(tuple(stats))


def zscore(df: DataFrame) -> DataFrame:
    """All numeric columns minus their mean over their sample deviation; the others go."""
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    return Scale(sample=True).fit(df).apply(df.select(*[col(c) for c in numeric]))
