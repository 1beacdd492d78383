"""Profiles, type narrowing and encodings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.catalog.common import query, r6, sql_r6, table
from martloom.operators.encoding import (
    Encode,
    OneHotBoolean,
    ReduceBooleans,
    SparseOneHot,
    fit_dates,
    fit_one_hot,
    label_encode,
)
from martloom.operators.narrowing import fit_narrowing, model_cast
from martloom.operators.profile import column_profile, column_sketches, merge_sketches, sketch_counts
from martloom.plans.chain import narrowing_new


def _items(spark, sf):
    """Lineitem with columns that narrow to every kind of type."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        F.expr("nullif(l_quantity, 7)").alias("gaps"),
        (F.col("l_quantity") - 30).alias("shifted"),
        (F.col("l_orderkey") * -100000).alias("deep"),
        (F.col("l_orderkey") * 1000000000).alias("wide"),
        (F.col("l_extendedprice") * 1e36).alias("huge"),
        F.lit(None).cast("double").alias("empty"),
        "l_returnflag",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"),
        F.expr("nullif(date_format(l_shipdate, 'dd/MM/yyyy'), '01/01/1998')").alias("shipped_alt"),
    )


SQL_ITEMS = """
select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, nullif(l_quantity, 7) as gaps,
       l_quantity - 30 as shifted, l_orderkey * -100000 as deep, l_orderkey * 1000000000 as wide,
       l_extendedprice * 1e36::double as huge, null::double as empty, l_returnflag,
       strftime(l_shipdate, '%Y-%m-%d') as shipped,
       nullif(strftime(l_shipdate, '%d/%m/%Y'), '01/01/1998') as shipped_alt
from lineitem
"""
NUMBERS = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "gaps", "shifted", "deep",
           "wide", "huge", "empty")


def _sql_type(column: str, pandas: bool = False, source: str = SQL_ITEMS) -> str:
    c = f"{column}::double"
    whole = f"count(*) filter (where {c} <> round({c})) = 0"
    if pandas:
        whole += f" and (typeof(any_value({column})) <> 'DOUBLE' or count(*) = count({column}))"
    small = "float16" if pandas else "float32"
    half = f"when min({c}) >= -65504 and max({c}) <= 65504 then 'float16'" if pandas else ""
    return f"""select '{column}' as "column", case
      when count({column}) = 0 then '{small}'
      when {whole} and min({c}) >= 0 and max({c}) < 18446744073709551616 then case when max({c}) <= 255 then 'uint8' when max({c}) <= 65535 then 'uint16'
        when max({c}) <= 4294967295 then 'uint32' else 'uint64' end
      when {whole} and min({c}) < 0 and min({c}) >= -9223372036854775808 and max({c}) < 9223372036854775808
        then case when min({c}) >= -128 and max({c}) <= 127 then 'int8'
        when min({c}) >= -32768 and max({c}) <= 32767 then 'int16'
        when min({c}) >= -2147483648 and max({c}) <= 2147483647 then 'int32' else 'int64' end
      {half}
      when max(abs({c})) <= 3.4028234663852886e38 then 'float32' else 'float64' end as type_name
      from ({source})"""


def _sql_text(column: str, pandas: bool = False) -> str:
    day, other = ("datetime64", "category") if pandas else ("date", "categorical")
    pattern = r"\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4}"
    return f"""select '{column}' as "column",
      case when bool_and(coalesce(regexp_matches({column}, '{pattern}'), true)) then '{day}' else '{other}' end
      as type_name from ({SQL_ITEMS})"""


TEXTS = ("l_returnflag", "shipped", "shipped_alt")


@query(" union all ".join([*map(_sql_type, NUMBERS), *map(_sql_text, TEXTS)]))
def narrow_types_report(spark, sf):
    df = _items(spark, sf)
    return fit_narrowing(df).report(df)


@query(" union all ".join([*[_sql_type(c, True) for c in NUMBERS], *[_sql_text(c, True) for c in TEXTS]]))
def narrow_types_pandas(spark, sf):
    df = _items(spark, sf)
    return fit_narrowing(df, flavour="pandas").report(df)


@query(f"""
select l_orderkey, l_linenumber::smallint as l_linenumber, l_quantity::smallint as l_quantity,
       gaps::smallint as gaps, shifted::tinyint as shifted, wide, l_returnflag,
       shipped::date as shipped, strptime(shipped_alt, '%d/%m/%Y')::date as shipped_alt
from ({SQL_ITEMS})
""")
def narrow_types_apply(spark, sf):
    df = _items(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_quantity", "gaps", "shifted", "wide", "l_returnflag", "shipped", "shipped_alt"
    )
    return fit_narrowing(df, ignore=("l_orderkey",)).apply(df)


_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy")
_SQL_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y")


@query(f"""
select o_orderkey, coalesce({", ".join(f"try_strptime(day, '{f}')" for f in _SQL_FORMATS)})::date as day
from (select o_orderkey, case o_orderkey % 4 {" ".join(
    f"when {i} then strftime(o_orderdate, '{f}')" for i, f in enumerate(_SQL_FORMATS))} end as day from orders)
""")
def date_detect_cast(spark, sf):
    form = F.lit(None).cast("string")
    for i, f in enumerate(_FORMATS):
        form = F.when(F.col("o_orderkey") % 4 == i, F.date_format("o_orderdate", f)).otherwise(form)
    df = table(spark, sf, "orders").select("o_orderkey", form.alias("day"))
    return fit_narrowing(df, ignore=("o_orderkey",)).apply(df)


_MOMENTS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd'T'HH:mm", "dd-MM-yyyy HH:mm:ss.SSS", "dd/MM/yyyy")


@query("""
select o_orderkey, case o_orderkey % 4 when 3 then o_orderdate::date::timestamp
         else o_orderdate::date + to_minutes((o_orderkey % 1440)::bigint) end as moment, 'datetime' as type_name
from orders
""")
def timestamp_detect_cast(spark, sf):
    """Texts of dates with and without a time of day, in four layouts."""
    at = F.col("o_orderdate").cast("date").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    form = F.lit(None).cast("string")
    for i, f in enumerate(_MOMENTS):
        form = F.when(F.col("o_orderkey") % 4 == i, F.date_format(at, f)).otherwise(form)
    df = table(spark, sf, "orders").select("o_orderkey", form.alias("moment"))
    plan = fit_narrowing(df, ignore=("o_orderkey",))
    return plan.apply(df).withColumn("type_name", F.lit(plan.columns[0].logical))


def _sql_profile(column: str, kind: str, source: str) -> str:
    if kind == "text":
        low = high = "null::double"
    elif kind == "time":
        low, high = (f"datediff('day', date '1970-01-01', {f}({column})::date)::double" for f in ("min", "max"))
    else:
        low, high = (f"{f}({column})::double" for f in ("min", "max"))
    return f"""select '{column}' as "column", count(*) as n_rows, count(*) - count({column}) as n_null,
      count(distinct {column}) as n_distinct, {low} as min_value, {high} as max_value from ({source})"""


_SQL_PROFILED = """select o_orderkey, nullif(o_custkey % 7, 0) as o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  o_orderpriority from orders"""


@query(
    " union all ".join(
        _sql_profile(c, k, _SQL_PROFILED)
        for c, k in (
            ("o_orderkey", "number"),
            ("o_custkey", "number"),
            ("o_orderstatus", "text"),
            ("o_totalprice", "number"),
            ("o_orderdate", "time"),
            ("o_orderpriority", "text"),
        )
    )
)
def column_profiles(spark, sf):
    return column_profile(
        table(spark, sf, "orders").withColumn("o_custkey", F.expr("nullif(o_custkey % 7, 0)"))
    )


@query(
    " union all ".join(
        f"""select '{c}' as "column", count(*) as n_rows, count(*) - count({c}) as n_null, true as close from events"""
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    )
)
def column_sketches_merged(spark, sf):
    """Sketches of each event type's rows, merged; the estimate is within 5 % of the exact number."""
    events = table(spark, sf, "events")
    kinds = [r[0] for r in events.select("event_type").distinct().collect()]
    parts = [column_sketches(events.where(F.col("event_type").eqNullSafe(F.lit(k)))) for k in kinds]
    exact = column_profile(events).select("column", F.col("n_distinct").alias("exact"))
    out = sketch_counts(merge_sketches(reduce(DataFrame.unionByName, parts))).join(exact, "column")
    close = F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))
    return out.select("column", "n_rows", "n_null", close.alias("close"))


SQL_NEW = "select l_quantity * 2 as double_qty, l_extendedprice * (1 + l_tax) as price_sum from lineitem"


@query(" union all ".join(_sql_type(c, source=SQL_NEW) for c in ("double_qty", "price_sum")))
def narrow_new_columns(spark, sf):
    add = narrowing_new(
        lambda df: df.withColumns(
            {"double_qty": F.col("l_quantity") * 2, "price_sum": F.col("l_extendedprice") * (1 + F.col("l_tax"))}
        )
    )
    out = add(table(spark, sf, "lineitem"))
    new = [(f.name, f.metadata["ref_type"]) for f in out.schema.fields if "ref_type" in f.metadata]
    return spark.createDataFrame(new, "`column` string, type_name string")


@query(f"""
select l_orderkey, l_linenumber, {sql_r6("l_quantity::float::double")} as l_quantity,
       {sql_r6("l_extendedprice::float::double")} as l_extendedprice, (l_returnflag = 'R')::smallint as label
from lineitem
""")
def model_types(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    out = model_cast(df, ["l_quantity", "l_extendedprice"], "label")
    return out.select(
        "l_orderkey",
        "l_linenumber",
        r6(F.col("l_quantity").cast("double")).alias("l_quantity"),
        r6(F.col("l_extendedprice").cast("double")).alias("l_extendedprice"),
        "label",
    )


# -- encodings ----------------------------------------------------------------

FLAGS = ("A", "N", "R")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _flagged(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_linestatus",
        F.when(F.col("l_quantity") > 5, F.col("l_returnflag")).alias("flag"),
    )


SQL_FLAGGED = """
select l_orderkey, l_linenumber, l_linestatus, case when l_quantity > 5 then l_returnflag end as flag from lineitem
"""


@query(f"""
select l_orderkey, l_linenumber, {", ".join(f'(l_linestatus = {v!r})::smallint as "l_linestatus_{v}"' for v in "FO")},
       {", ".join(f'coalesce((flag = {v!r})::smallint, 0::smallint) as "flag_{v}"' for v in FLAGS)},
       (flag is null)::smallint as flag_null
from ({SQL_FLAGGED})
""")
def one_hot(spark, sf):
    df = _flagged(spark, sf)
    return fit_one_hot(df, ["l_linestatus", "flag"]).apply(df)


@query(f"""
select l_orderkey, l_linenumber, {", ".join(f'(l_linestatus = {v!r}) as "l_linestatus_{v}"' for v in "FO")},
       {", ".join(f'coalesce(flag = {v!r}, false) as "flag_{v}"' for v in FLAGS)}, (flag is null) as flag_nan
from ({SQL_FLAGGED})
""")
def one_hot_boolean(spark, sf):
    df = _flagged(spark, sf)
    return OneHotBoolean().fit(df).apply(df)


def _wide_text(spark, sf):
    """Every line's order as a text of its own, and a short column with nulls."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("big"),
        F.when(F.col("l_quantity") > 5, F.col("l_returnflag")).alias("small"),
    )


@query("""
with d as (select l_orderkey, l_linenumber, 'order ' || l_orderkey as big, case when l_quantity > 5 then l_returnflag end as small
           from lineitem),
  n as (select count(distinct big) as big, count(distinct small) as small from d)
select l_orderkey, l_linenumber, (dense_rank() over (order by big) - 1)::int as position from d
union all
select l_orderkey, l_linenumber,
  (n.big + case when d.small is null then n.small else dense_rank() over (order by d.small nulls last) - 1 end)::int from d, n
""")
def one_hot_sparse(spark, sf):
    """The set flags of one vector over all orders and return flags."""
    df = _wide_text(spark, sf)
    out = SparseOneHot(("big", "small")).fit(df).apply(df)
    return out.select("l_orderkey", "l_linenumber", F.explode(F.unwrap_udt("flags")["indices"]).alias("position"))


@query("""
select c_custkey, dense_rank() over (order by c_name) - 1 as encoded_c_name,
       dense_rank() over (order by c_mktsegment) - 1 as encoded_c_mktsegment
from customer
""")
def label_codes_encode(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return label_encode(label_encode(df, "c_name"), "c_mktsegment")


@query("""
select o_orderkey, isodow(o_orderdate)::smallint as day_weekday, day(o_orderdate)::smallint as day_day_of_month,
       dayofyear(o_orderdate)::int as day_day_of_year,
       datediff('day', date '1970-01-01', o_orderdate::date)::int as day_unix
from orders
""")
def date_features(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return fit_dates(df, ("weekday", "day_of_month", "day_of_year", "unix")).apply(df)


@query("""
select c_custkey, """ + ", ".join(f"(c_mktsegment = '{v}')::smallint as \"c_mktsegment_{v}\"" for v in SEGMENTS) + """
from customer
""")
def encode_stage(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    df = fit_narrowing(df, ignore=("c_custkey",)).apply(df)
    return Encode().fit(df).apply(df)


# Two columns reduce to one component, whose direction has a closed form.
@query(f"""
with d as (select l_orderkey, l_linenumber, (l_quantity > 25)::int as a, (l_quantity > 35)::int as b from lineitem),
  m as (select avg(a) as ma, avg(b) as mb,
          0.5::double * atan2(2 * covar_samp(a, b), var_samp(a) - var_samp(b)) as t from d),
  s as (select *, case when abs(cos(t)) >= abs(sin(t)) then sign(cos(t)) else sign(sin(t)) end as side from m)
select l_orderkey, l_linenumber, {sql_r6("side * ((a - ma) * cos(t) + (b - mb) * sin(t))")} as x_0 from d, s
""")
def reduce_two_booleans(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).alias("a"), (F.col("l_quantity") > 35).alias("b")
    )
    out = ReduceBooleans().fit(df).apply(df)
    return out.select("l_orderkey", "l_linenumber", r6("x_0").alias("x_0"))


@query()
def reduce_booleans(spark, sf):
    df = OneHotBoolean().fit(_flagged(spark, sf)).apply(_flagged(spark, sf))
    out = ReduceBooleans().fit(df).apply(df)
    return out.select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in out.columns if c.startswith("x_")])
