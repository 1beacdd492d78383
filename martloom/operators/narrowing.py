"""Type narrowing: dates from text, categories, the smallest numeric type that fits."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.functions.dates import DATE_FORMATS, parse_date, parse_moment
from martloom.functions.values import col, is_numeric, present_sql, quoted
from martloom.operators.plan import Identity, Plan
from martloom.operators.profile import ColumnStats, Profile, integral, profile

# Logical type ladders as (name, smallest, largest, Spark type). Spark has
# no unsigned and no half types, so each maps to the smallest Spark type holding its range.
UNSIGNED = (
    ("uint8", 0, 2**8 - 1, T.ShortType()),
    ("uint16", 0, 2**16 - 1, T.IntegerType()),
    ("uint32", 0, 2**32 - 1, T.LongType()),
    ("uint64", 0, 2**63 - 1, T.LongType()),
    ("uint64", 0, 2**64 - 1, T.DecimalType(20, 0)),
)
SIGNED = (
    ("int8", -(2**7), 2**7 - 1, T.ByteType()),
    ("int16", -(2**15), 2**15 - 1, T.ShortType()),
    ("int32", -(2**31), 2**31 - 1, T.IntegerType()),
    ("int64", -(2**63), 2**63 - 1, T.LongType()),
)
HALF = ("float16", -65504.0, 65504.0, T.FloatType())
FLOATS = (
    ("float32", -3.4028234663852886e38, 3.4028234663852886e38, T.FloatType()),
    ("float64", -1.7976931348623157e308, 1.7976931348623157e308, T.DoubleType()),
)

FLAVOURS = ("polars", "pandas")


@dataclass(frozen=True)
class Narrowing:
    """What one column becomes. `logical` is the type name recorded in its metadata."""

    name: str
    logical: str
    type: T.DataType
    formats: tuple[str, ...] = ()
    timed: bool = False

    def expression(self) -> Column:
        c = col(self.name)
        if self.formats:
            parse = parse_moment if self.timed else parse_date
            c = F.expr(parse(quoted(self.name), self.formats)).cast(self.type)
        elif self.logical not in ("categorical", "category"):
            c = c.cast(self.type)
        kind = {"logical": "categorical"} if self.logical in ("categorical", "category") else {}
        return c.alias(self.name, metadata={"ref_type": self.logical, **kind})


@dataclass(frozen=True)
class NarrowPlan:
    columns: tuple[Narrowing, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        by_name = {n.name: n for n in self.columns}
        return df.select(*[by_name[c].expression() if c in by_name else col(c) for c in df.columns])

    def report(self, df: DataFrame) -> DataFrame:
        """The plan as a table (column, type_name)."""
        rows = [(n.name, n.logical) for n in self.columns]
        return df.sparkSession.createDataFrame(rows, "`column` string, type_name string")


def is_categorical(f: T.StructField) -> bool:
    return f.metadata.get("logical") == "categorical"


def _fits(ladder, low, high):
    for name, smallest, largest, t in ladder:
        if low >= smallest and high <= largest:
            return name, t
    return None


def number_type(s: ColumnStats, flavour: str = "polars") -> tuple[str, T.DataType]:
    """Logical and Spark type a numeric column narrows to."""
    floats = (HALF, *FLOATS) if flavour == "pandas" else FLOATS
    if s.n_present == 0:
        return floats[0][0], floats[0][3]
    low, high = s.min, s.max
    whole = integral(s) and not (
        flavour == "pandas" and s.n_null and isinstance(s.type, (T.FloatType, T.DoubleType))
    )
    if math.isinf(low) or math.isinf(high):
        return "float64", T.DoubleType()
    if whole:
        found = _fits(UNSIGNED if low >= 0 else SIGNED, low, high)
        if found:
            return found
    return _fits(floats, float(low), float(high)) or ("float64", T.DoubleType())


def _date_formats(s: ColumnStats) -> tuple[str, ...]:
    """Formats that occur in a detected date column."""
    return tuple(f for f, n in zip(DATE_FORMATS, s.n_formats) if n) or DATE_FORMATS[:1]


def fit_narrowing(
    df: DataFrame,
    ignore: tuple[str, ...] = (),
    columns: list[str] | None = None,
    flavour: str = "polars",
    stats: Profile | None = None,
) -> Plan:
    """Learn the narrow type of every column (or of `columns`) that is not ignored."""
    if flavour not in FLAVOURS:
        raise ValueError(f"flavour must be one of {FLAVOURS}")
    chosen = [f for f in df.schema.fields if f.name not in ignore and (columns is None or f.name in columns)]
    texts_and_numbers = [
        f.name
        for f in chosen
        if is_numeric(f.dataType)
        or isinstance(f.dataType, T.NullType)
        or isinstance(f.dataType, T.StringType) and not is_categorical(f)
    ]
    if not texts_and_numbers:
        return NarrowPlan(())
    stats = stats or profile(df, texts_and_numbers)
    if stats.n_rows == 0:
        return Identity()
    dates = [n for n in texts_and_numbers if stats[n].n_not_date == 0]
    unparsed = {n: stats[n].n_unparsed for n in dates if stats[n].n_unparsed}
    if unparsed:
        raise ValueError(f"date columns with values no format parses: {unparsed}")
    out = []
    for f in chosen:
        s = stats.columns.get(f.name)
        if s is None:
            continue
        if f.name in dates:
            timed = bool(s.n_timed)
            day = ("datetime64", T.TimestampNTZType()) if flavour == "pandas" else ("date", T.DateType())
            day = ("datetime", T.TimestampNTZType()) if timed and flavour != "pandas" else day
            out.append(Narrowing(f.name, *day, formats=_date_formats(s), timed=timed))
        elif isinstance(f.dataType, T.StringType):
            out.append(Narrowing(f.name, "category" if flavour == "pandas" else "categorical", f.dataType))
        else:
            out.append(Narrowing(f.name, *number_type(s, flavour)))
    return NarrowPlan(tuple(out))


def fit_new_columns(df: DataFrame, before: list[str]) -> Plan:
    """Narrow only the columns that `before` does not have."""
    return fit_narrowing(df, columns=[c for c in df.columns if c not in before])


@dataclass(frozen=True)
class Narrow:
    """Chain stage: narrow the whole table."""

    ignore: tuple[str, ...] = ()
    flavour: str = "polars"

    def fit(self, df: DataFrame) -> Plan:
        return fit_narrowing(df, self.ignore, flavour=self.flavour)


def model_cast(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """Features to float and the label to smallint, the types the models take."""
    wanted = set(features)

    def cast(f: T.StructField) -> str:
        c = present_sql(f.name, f.dataType)
        to = "float" if f.name in wanted else "smallint" if f.name == label else None
        return f"cast({c} as {to}) as {quoted(f.name)}" if to else quoted(f.name)

    return df.selectExpr(*[cast(f) for f in df.schema.fields])
