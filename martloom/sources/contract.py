"""Schema contracts: declared columns, types and value checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.functions.values import col, present


class ContractError(ValueError):
    """A table breaks its contract; `violations` holds (column, check, n_bad)."""

    def __init__(self, violations):
        self.violations = violations
        super().__init__(f"contract violations: {violations}")


@dataclass(frozen=True)
class Field:
    """One declared column. Bounds are inclusive; nulls pass the value checks if nullable."""

    name: str
    type: T.DataType
    nullable: bool = False
    isin: tuple = ()
    ge: object = None
    le: object = None

    def violations(self, actual: T.DataType) -> dict[str, Column]:
        """Check name -> condition that is true for a bad row."""
        c = present(self.name, actual)
        out = {}
        if not self.nullable:
            out["not_null"] = c.isNull()
        if self.isin:
            out["isin"] = c.isNotNull() & ~c.isin(*self.isin)
        if self.ge is not None:
            out["ge"] = c < F.lit(self.ge)
        if self.le is not None:
            out["le"] = c > F.lit(self.le)
        return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Contract:
    """Declared columns; columns beyond them pass."""

    fields: tuple[Field, ...] = field(default_factory=tuple)

    def _same_type(self, want: T.DataType, have: T.DataType) -> bool:
        return want == have or isinstance(want, INTEGERS) and isinstance(have, INTEGERS)

    def _structural(self, df: DataFrame) -> list[tuple[str, str]]:
        have = {f.name: f.dataType for f in df.schema.fields}
        out = []
        for f in self.fields:
            if f.name not in have:
                out.append((f.name, "present"))
            elif not self._same_type(f.type, have[f.name]):
                out.append((f.name, "type"))
        return out

    def _checks(self, df: DataFrame) -> list[tuple[str, str, Column]]:
        """Value checks of the columns that are there with the right type."""
        broken = {c for c, _ in self._structural(df)}
        types = {f.name: f.dataType for f in df.schema.fields}
        ok = [f for f in self.fields if f.name not in broken]
        return [(f.name, k, e) for f in ok for k, e in f.violations(types[f.name]).items()]

    def report(self, df: DataFrame) -> DataFrame:
        """(column, check, n_bad, n_rows) for every check, from one aggregation."""
        checks = self._checks(df)
        aggs = [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(e).alias(f"v{i}") for i, (_, _, e) in enumerate(checks)]]
        entries = [
            F.struct(F.lit(c).alias("column"), F.lit(k).alias("check"), F.col(f"v{i}").alias("n_bad"), F.col("n_rows"))
            for i, (c, k, _) in enumerate(checks)
        ]
        entries += [
            F.struct(F.lit(c).alias("column"), F.lit(k).alias("check"), F.col("n_rows").alias("n_bad"), F.col("n_rows"))
            for c, k in self._structural(df)
        ]
        return df.agg(*aggs).select(F.inline(F.array(*entries)))

    def validate(self, df: DataFrame) -> DataFrame:
        """The table itself, or ContractError."""
        broken = [(c, k, None) for c, k in self._structural(df)]
        if not broken:
            broken = [(r["column"], r["check"], r["n_bad"]) for r in self.report(df).where("n_bad > 0").collect()]
        if broken:
            raise ContractError(broken)
        return df

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows that pass, rows that break any value check)."""
        checks = [e for _, _, e in self._checks(df)]
        bad = reduce(Column.__or__, checks) if checks else F.lit(False)
        return df.where(~bad), df.where(bad)


# The contract of the penguin measurements table.
PENGUINS = Contract(
    (
        Field("species", T.StringType(), isin=("Adelie", "Gentoo", "Chinstrap")),
        Field("island", T.StringType(), isin=("Torgersen", "Biscoe", "Dream")),
        Field("bill_length_mm", T.DoubleType(), nullable=True, ge=32.1, le=59.6),
        Field("bill_depth_mm", T.DoubleType(), nullable=True, ge=13.1, le=21.5),
        Field("flipper_length_mm", T.DoubleType(), nullable=True, ge=172.0, le=231.0),
        Field("body_mass_g", T.DoubleType(), nullable=True, ge=2700.0, le=6300.0),
        Field("sex", T.StringType(), nullable=True, isin=("male", "female")),
        Field("year", T.IntegerType(), ge=2007, le=2009),
    )
)
