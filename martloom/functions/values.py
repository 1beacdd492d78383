"""Null handling and scaling arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FLOATING + (T.DecimalType,)


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its plain name; dots and spaces in it are part of the name."""
    return F.col(quoted(name))


def present(name: str, t: T.DataType) -> Column:
    """The column with NaN read as null, as the other operators expect it."""
    return F.nanvl(col(name), F.lit(None).cast(t)) if isinstance(t, FLOATING) else col(name)


def present_sql(name: str, t: T.DataType) -> str:
    """`present` as SQL text, which costs one call however many columns there are."""
    c = quoted(name)
    return f"nanvl({c}, cast(null as {t.simpleString()}))" if isinstance(t, FLOATING) else c


def _literal(x: float) -> str:
    """A number as SQL text; statistics of a column with infinite values may be infinite or NaN."""
    return f"({float(x)!r}D)" if math.isfinite(x) else f"cast('{float(x)!r}' as double)"


def standard_sql(c: str, mean: float | None, std: float | None) -> str:
    """(x - mean) / std; a zero std divides by one, a missing mean gives null."""
    if mean is None:
        return "cast(null as double)"
    return f"(cast({c} as double) - {_literal(mean)}) / {_literal(std or 1.0)}"


def unstandard(c: Column, mean: float | None, std: float | None) -> Column:
    if mean is None:
        return F.lit(None).cast("double")
    return c.cast("double") * F.lit(float(std) if std else 1.0) + F.lit(float(mean))
