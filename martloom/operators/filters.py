"""Column filters learned from statistics, and row-level cleaning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.functions.values import FLOATING, col, present
from martloom.operators.narrowing import is_categorical
from martloom.operators.plan import DropColumns, Identity, Plan
from martloom.operators.profile import ColumnStats, distinct_values, profile


def _candidates(df: DataFrame, ignore: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c not in ignore]


@dataclass(frozen=True)
class DropNullHeavy:
    """Drop columns whose null share is strictly above the threshold."""

    threshold: float = 0.95
    ignore: tuple[str, ...] = ()

    def fit(self, df: DataFrame) -> Plan:
        names = _candidates(df, self.ignore)
        p = profile(df, names, want=("nulls",))
        if not p.n_rows:
            return Identity()
        void = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
        return DropColumns(tuple(c for c in names if c in void or p[c].null_share > self.threshold))


@dataclass(frozen=True)
class DropConstant:
    """Drop columns with exactly one distinct value; an all-null column stays."""

    ignore: tuple[str, ...] = ()

    def fit(self, df: DataFrame) -> Plan:
        names = _candidates(df, self.ignore)
        p = profile(df, names, want=("range", "text_range"))
        if not p.n_rows:
            return Identity()
        return DropColumns(tuple(c for c in names if p[c].min is not None and p[c].min == p[c].max))


@dataclass(frozen=True)
class DropHighCardinality:
    """Drop categorical columns with `threshold` or more values, null being a value.

    `columns` names the categorical columns where they carry no type mark yet.
    """

    threshold: int = 10
    ignore: tuple[str, ...] = ()
    columns: tuple[str, ...] | None = None

    def fit(self, df: DataFrame) -> Plan:
        names = [
            f.name
            for f in df.schema.fields
            if f.name not in self.ignore and (f.name in self.columns if self.columns else is_categorical(f))
        ]
        if not names:
            return DropColumns(())
        found = distinct_values(df, names, self.threshold)
        wide = [c for c, d in found.items() if d.values is None or len(d.values) + (d.n_null > 0) >= self.threshold]
        return DropColumns(tuple(wide))


@dataclass(frozen=True)
class DropWhere:
    """Drop columns whose statistics meet a condition."""

    condition: Callable[[ColumnStats], bool]
    ignore: tuple[str, ...] = ()

    def fit(self, df: DataFrame) -> Plan:
        p = profile(df, _candidates(df, self.ignore), want=("nulls", "range", "text_range", "fraction"))
        if not p.n_rows:
            return Identity()
        return DropColumns(tuple(c for c, s in p.columns.items() if self.condition(s)))


def remove_rows(df: DataFrame, columns: list[str], condition: Callable[[Column], Column]) -> DataFrame:
    """Keep rows where the condition is not true in any listed column (null is not true)."""
    keep = [~F.coalesce(condition(col(c)), F.lit(False)) for c in columns]
    return df.filter(reduce(Column.__and__, keep)) if keep else df


def replace_values(df: DataFrame, columns: list[str], condition: Callable[[Column], Column], value) -> DataFrame:
    """Set `value` where the condition holds, column by column."""
    return df.withColumns({c: F.when(condition(col(c)), F.lit(value)).otherwise(col(c)) for c in columns})


@dataclass(frozen=True)
class FillPlan:
    values: tuple[tuple[str, float], ...]

    def apply(self, df: DataFrame) -> DataFrame:
        fill = dict(self.values)
        fields = [f for f in df.schema.fields if f.name in fill]
        return df.withColumns({f.name: F.coalesce(present(f.name, f.dataType), F.lit(fill[f.name])) for f in fields})


@dataclass(frozen=True)
class FillBelowMin:
    """Fill nulls of double columns with a value far below the column's minimum."""

    offset: float = 100000.0  # fixed value
    ignore: tuple[str, ...] = ()

    def fit(self, df: DataFrame) -> Plan:
        names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType) and f.name not in self.ignore]
        if not names:
            return FillPlan(())
        p = profile(df, names, want=("range",))
        return FillPlan(tuple((c, p[c].min - self.offset) for c in names if p[c].min is not None))


def align(df: DataFrame, columns: list[str], types: dict[str, T.DataType] | None = None) -> DataFrame:
    """Give `df` exactly `columns`, in that order.

    Extra columns go; a missing one is 1.0 when its name holds "null", else null.
    """
    have = set(df.columns)
    out = []
    for c in columns:
        if c in have:
            out.append(col(c))
        else:
            t = (types or {}).get(c, T.DoubleType())
            out.append(F.lit(1.0 if "null" in c else None).cast(t).alias(c))
    return df.select(*out)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns read as null."""
    floats = [f for f in df.schema.fields if isinstance(f.dataType, FLOATING)]
    return df.withColumns({f.name: present(f.name, f.dataType) for f in floats}) if floats else df
