"""Joins and unions that build the wide table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from martloom.functions.values import col

# Widening order of numeric types.
NUMBER_ORDER = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def supertype(a: T.DataType, b: T.DataType) -> T.DataType:
    """Smallest type that holds both; text when nothing else does."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, NUMBER_ORDER) and isinstance(b, NUMBER_ORDER):
        ranks = sorted((NUMBER_ORDER.index(type(a)), NUMBER_ORDER.index(type(b))))
        # A float cannot hold every int or bigint.
        if NUMBER_ORDER[ranks[1]] is T.FloatType and NUMBER_ORDER[ranks[0]] in (T.IntegerType, T.LongType):
            return T.DoubleType()
        return NUMBER_ORDER[ranks[1]]()
    if isinstance(a, T.DecimalType) and isinstance(b, (T.DecimalType, *NUMBER_ORDER)):
        return T.DoubleType()
    if isinstance(b, T.DecimalType) and isinstance(a, NUMBER_ORDER):
        return T.DoubleType()
    if isinstance(a, T.DateType) and isinstance(b, (T.TimestampType, T.TimestampNTZType)):
        return b
    if isinstance(b, T.DateType) and isinstance(a, (T.TimestampType, T.TimestampNTZType)):
        return a
    return T.StringType()


def union_relaxed(parts: list[DataFrame]) -> DataFrame:
    """Union by name; missing columns are null, clashing types widen."""
    types: dict[str, T.DataType] = {}
    for part in parts:
        for f in part.schema.fields:
            types[f.name] = supertype(types[f.name], f.dataType) if f.name in types else f.dataType
    cast = [p.select(*[col(f.name).cast(types[f.name]).alias(f.name) for f in p.schema.fields]) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def merge_features(base: DataFrame, tables: list[DataFrame], key: str, empty: list[bool] | None = None) -> DataFrame:
    """Left-join every table to the base on the key.

    A column of table i that the result already has gets the suffix `_{i}`. `empty` marks
    tables without rows: they are left out but keep their number. All joins share the key,
    so the base is shuffled once and small tables are broadcast where Catalyst sees fit.
    """
    out = base
    for i, table in enumerate(tables):
        if empty and empty[i]:
            continue
        taken = set(out.columns)
        renamed = []
        for c in table.columns:
            new = f"{c}_{i}" if c != key and c in taken else c
            if new != c and (new in taken or new in table.columns):
                raise ValueError(f"column {new} of table {i} is already there")
            renamed.append(col(c).alias(new))
        out = out.join(table.select(*renamed), key, "left")
    return out


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the key table."""
    return df.join(keys.select(key), key, "left_semi")


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(col(key)).distinct()


def join_report(runs: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Runs with the metrics of the same id; runs without metrics stay."""
    return runs.join(metrics, key, "left")
