"""One-pass column statistics (null counts, ranges, distinct counts, sizes)."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.functions.dates import DATE_FORMATS, DATE_PATTERN, format_start, has_time, parse_date, parse_moment
from martloom.functions.values import FLOATING, INTEGRAL, col, is_numeric, present, present_sql, quoted

# Columns per aggregation job: generated code for many more is too large to be compiled
# well. Batches scan only their own columns and run side by side.
COLUMN_BATCH = 50
PARALLEL = 4

# approx_count_distinct at its default error keeps 512 registers and counts linearly
# while few are set, so n values never give more than 512 * ln(512 / (512 - n)).
HLL_REGISTERS = 512
HLL_LINEAR_LIMIT = 256


@dataclass(frozen=True)
class ColumnStats:
    """Statistics of one column; those not asked for are None."""

    name: str
    type: T.DataType
    n_rows: int
    n_null: int
    min: object = None
    max: object = None
    n_fraction: int | None = None
    n_not_date: int | None = None
    n_unparsed: int | None = None
    n_timed: int | None = None
    n_formats: tuple[int, ...] = ()
    n_bytes: int | None = None

    @property
    def n_present(self) -> int:
        return self.n_rows - self.n_null

    @property
    def null_share(self) -> float:
        return self.n_null / self.n_rows if self.n_rows else math.nan


@dataclass(frozen=True)
class Profile:
    n_rows: int
    columns: dict[str, ColumnStats] = field(default_factory=dict)

    def __getitem__(self, name: str) -> ColumnStats:
        return self.columns[name]


def batched(df: DataFrame, per_column: list[list[str]], alone: tuple[int, ...] = ()) -> dict[str, object]:
    """The values of SQL aggregates, given as `... as name` per column, and the row count `n`.

    The table is read once over all batches, each of which scans its own columns. `alone` has
    the places of columns whose code fills a batch: two of them are more than the JVM compiles.
    """
    rest = [column for i, column in enumerate(per_column) if i not in alone]
    batches = [rest[i : i + COLUMN_BATCH] for i in range(0, len(rest), COLUMN_BATCH)]
    batches = [[per_column[i]] for i in alone] + batches or [[]]

    def run(batch: list[list[str]]) -> dict[str, object]:
        return df.selectExpr("count(1) as n", *[e for column in batch for e in column]).first().asDict()

    if len(batches) == 1:
        return run(batches[0])
    with ThreadPoolExecutor(PARALLEL) as pool:
        found = pool.map(inheritable_thread_target(df.sparkSession)(run), batches)
        return {k: v for values in found for k, v in values.items()}


def _expressions(f: T.StructField, want: frozenset[str]) -> dict[str, str]:
    t, c = f.dataType, present_sql(f.name, f.dataType)
    out = {}
    if "nulls" in want:
        out["n_null"] = f"count_if({c} is null)"
    ordered = is_numeric(t) or isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))
    if "range" in want and ordered or "text_range" in want and isinstance(t, (T.StringType, T.BooleanType)):
        out["min"], out["max"] = f"min({c})", f"max({c})"
    if "fraction" in want and isinstance(t, (*FLOATING, T.DecimalType)):
        out["n_fraction"] = f"count_if(cast({c} as double) <> rint({c}))"
    if "dates" in want and isinstance(t, T.StringType):
        counts = ", ".join(f"count_if({format_start(c, form)})" for form in DATE_FORMATS)
        out["n_not_date"] = f"count_if(not {c} rlike r'{DATE_PATTERN}')"
        out["n_formats"] = f"array({counts})"
        out["n_unparsed"] = f"count_if({c} is not null and {parse_date(c)} is null and {parse_moment(c)} is null)"
        out["n_timed"] = f"count_if({has_time(c)})"
    if "bytes" in want and isinstance(t, T.StringType):
        out["n_bytes"] = f"coalesce(sum(octet_length({c})), 0)"
    return out


def profile(
    df: DataFrame,
    columns: list[str] | None = None,
    want: tuple[str, ...] = ("nulls", "range", "fraction", "dates"),
) -> Profile:
    """Statistics of the columns in one pass over the table.

    `want` picks among nulls, range, text_range, fraction, dates and bytes.
    """
    wanted = frozenset(want) | {"nulls"}
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    exprs = [_expressions(f, wanted) for f in fields]
    alone = tuple(i for i, x in enumerate(exprs) if "n_unparsed" in x)
    row = batched(df, [[f"{e} as s{i}_{k}" for k, e in x.items()] for i, x in enumerate(exprs)], alone)
    found = {}
    for i, f in enumerate(fields):
        stats = {k: row[f"s{i}_{k}"] for k in exprs[i]}
        stats["n_formats"] = tuple(stats.get("n_formats", ()))
        found[f.name] = ColumnStats(f.name, f.dataType, row["n"], **stats)
    return Profile(row["n"], found)


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(place, n_distinct): exact number of non-null values per column, by its place in `columns`.

    Each value becomes (place, two hashes), which a task reduces to the different ones before
    they are shuffled; 128 bits stand for the value. So a row costs one small pair per column,
    not a copy of itself per column, and values of one column are counted by many tasks.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    hashes = [present(f.name, f.dataType) for f in fields]
    pairs = [
        F.struct(F.lit(i).alias("place"), F.when(c.isNotNull(), F.xxhash64(c)).alias("a"), F.xxhash64(c, F.lit(i)).alias("b"))
        for i, c in enumerate(hashes)
    ]
    values = df.select(F.inline(F.array(*pairs))).groupBy("place", "a", "b").agg(F.lit(1).alias("one"))
    return values.groupBy("place").agg(F.count("a").alias("n_distinct"))


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """The profile as a table: one row per column, ranges as double (dates as epoch days).

    `exact=False` swaps the distinct counts for sketches, which need no shuffle of values.
    """
    per_column, fields = [], df.schema.fields
    for i, f in enumerate(fields):
        c, t = present_sql(f.name, f.dataType), f.dataType
        if is_numeric(t):
            low, high = f"cast(min({c}) as double)", f"cast(max({c}) as double)"
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            days = f"cast(unix_date(cast({c} as date)) as double)"
            low, high = f"min({days})", f"max({days})"
        else:
            low = high = "cast(null as double)"
        aggregates = [f"count_if({c} is null) as n{i}", f"{low} as l{i}", f"{high} as h{i}"]
        per_column.append(aggregates + ([] if exact else [f"approx_count_distinct({c}) as d{i}"]))
    row = batched(df, per_column)
    rows = [(i, f.name, row["n"], row[f"n{i}"], row[f"l{i}"], row[f"h{i}"], row.get(f"d{i}")) for i, f in enumerate(fields)]
    names = "place int, column string, n_rows bigint, n_null bigint, min_value double, max_value double, n_distinct bigint"
    found = df.sparkSession.createDataFrame(rows, names)
    if exact:
        # One row per column on both sides; the values of an empty table have no row.
        counts = distinct_counts(df)
        found = found.drop("n_distinct").join(counts, "place", "left").fillna(0, ["n_distinct"])
    return found.select("column", "n_rows", "n_null", "n_distinct", "min_value", "max_value")


def column_sketches(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_null, sketch): a distinct-count sketch per column that can be kept and merged, in one pass."""
    aggs, entries = [F.count(F.lit(1)).alias("n_rows")], []
    for i, f in enumerate(df.schema.fields):
        c = present(f.name, f.dataType)
        whole = isinstance(f.dataType, (T.IntegerType, T.LongType, T.StringType))
        aggs += [F.count_if(c.isNull()).alias(f"n{i}"), F.hll_sketch_agg(c if whole else c.cast("string")).alias(f"s{i}")]
        entries.append(F.struct(F.lit(f.name).alias("column"), F.col("n_rows"), F.col(f"n{i}").alias("n_null"), F.col(f"s{i}").alias("sketch")))
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """`column_sketches` of several parts of a table, united by name, as those of the whole."""
    return sketches.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.hll_union_agg("sketch").alias("sketch")
    )


def sketch_counts(sketches: DataFrame) -> DataFrame:
    """(column, n_rows, n_null, n_distinct): about 2 % of error."""
    return sketches.select("column", "n_rows", "n_null", F.hll_sketch_estimate("sketch").alias("n_distinct"))


def proves_at_least(estimate: int, n: int) -> bool:
    """Whether a distinct-count sketch can only have come from `n` or more values."""
    if n > HLL_LINEAR_LIMIT:
        return False
    return estimate > HLL_REGISTERS * math.log(HLL_REGISTERS / (HLL_REGISTERS - n + 1)) + 1


@dataclass(frozen=True)
class Distinct:
    """Sorted distinct non-null values, None where there are too many, and the null count."""

    values: list | None
    n_null: int


def distinct_values(df: DataFrame, columns: list[str], at_least: int) -> dict[str, Distinct]:
    """Distinct values per column, not listed for a column with `at_least` or more.

    A sketch pass first settles the columns that are certainly too wide, so the second
    pass gathers only sets of about `at_least` values.
    """
    if not columns:
        return {}
    names = [quoted(c) for c in columns]
    row = batched(
        df, [[f"approx_count_distinct({c}) as d{i}", f"count_if({c} is null) as n{i}"] for i, c in enumerate(names)]
    )
    if at_least <= HLL_LINEAR_LIMIT:
        narrow = [c for i, c in enumerate(columns) if not proves_at_least(row[f"d{i}"], at_least)]
    else:
        # Above the linear range: count exactly, columns far below the limit need no count.
        unsure = [c for i, c in enumerate(columns) if row[f"d{i}"] * 2 >= at_least]
        counts = {r.place: r.n_distinct for r in distinct_counts(df, unsure).collect()} if unsure else {}
        places = [f.name for f in df.schema.fields if f.name in unsure]
        wide = {c for i, c in enumerate(places) if counts.get(i, 0) >= at_least}
        narrow = [c for c in columns if c not in wide]
    out = {c: Distinct(None, row[f"n{i}"]) for i, c in enumerate(columns)}
    if narrow:
        sets = batched(df, [[f"collect_set({quoted(c)}) as v{i}"] for i, c in enumerate(narrow)])
        for i, c in enumerate(narrow):
            values = sets[f"v{i}"]
            if len(values) < at_least:
                out[c] = Distinct(sorted(values), out[c].n_null)
    return out


def table_bytes(p: Profile, types: dict[str, T.DataType] | None = None) -> int:
    """Size of the table: rows times the width of each type, strings by their bytes."""
    total = 0
    for name, s in p.columns.items():
        t = (types or {}).get(name, s.type)
        total += (s.n_bytes or 0) if isinstance(t, T.StringType) else p.n_rows * type_width(t)
    return total


def type_width(t: T.DataType) -> int:
    """Bytes per value of a fixed-width type."""
    widths = {
        T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
        T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
    }
    if isinstance(t, T.DecimalType):
        return 8 if t.precision <= 18 else 16
    return widths.get(type(t), 1)


def integral(s: ColumnStats) -> bool:
    return isinstance(s.type, INTEGRAL) or s.n_fraction == 0
