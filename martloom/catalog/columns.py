"""Column filters, correlation, projections and the step chains."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.catalog.common import SQL_BASE, base, query, r6, sql_r6, table
from martloom.functions.values import is_numeric
from martloom.operators.correlation import DropCorrelated, correlations
from martloom.operators.filters import DropConstant, DropHighCardinality, DropNullHeavy, DropWhere
from martloom.operators.narrowing import Narrow
from martloom.plans.chain import Chain
from martloom.plans.cleaning import CleaningConfig, ColumnRule, RowRule, ValueRule, clean, tidy
from martloom.plans.mart import feature_columns, parts_of
from martloom.plans.steps import step1, step2, step3


def _features(spark, sf):
    """Orders with columns that each filter has something to say about."""
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.expr("case when o_custkey % 50 = 0 then o_totalprice end").alias("rare"),
        F.expr("case when o_custkey % 2 = 0 then o_totalprice end").alias("half"),
        F.lit(None).cast("double").alias("empty"),
        F.lit(7).alias("seven"),
        F.expr("case when o_custkey % 3 = 0 then 'only' end").alias("single"),
        "o_orderstatus",
        "o_orderpriority",
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("customer"),
    )


SQL_FEATURES = """
select o_orderkey, o_totalprice, case when o_custkey % 50 = 0 then o_totalprice end as rare,
       case when o_custkey % 2 = 0 then o_totalprice end as half, null::double as empty, 7 as seven,
       case when o_custkey % 3 = 0 then 'only' end as single, o_orderstatus, o_orderpriority,
       'C' || o_custkey::varchar as customer
from orders
"""


@query(f"select * exclude (rare, empty) from ({SQL_FEATURES})")
def drop_null_heavy(spark, sf):
    df = _features(spark, sf)
    return DropNullHeavy(threshold=0.95).fit(df).apply(df)


@query(f"select * exclude (seven, single) from ({SQL_FEATURES})")
def drop_constant(spark, sf):
    df = _features(spark, sf)
    return DropConstant().fit(df).apply(df)


@query(f"select * exclude (customer) from ({SQL_FEATURES})")
def drop_high_cardinality(spark, sf):
    df = _features(spark, sf)
    texts = ("single", "o_orderstatus", "o_orderpriority", "customer")
    return DropHighCardinality(threshold=6, columns=texts).fit(df).apply(df)


@query(f"select * exclude (rare, half, empty, single) from ({SQL_FEATURES})")
def drop_where(spark, sf):
    df = _features(spark, sf)
    return DropWhere(lambda s: s.n_null > 0, ignore=("o_orderkey",)).fit(df).apply(df)


# -- correlation --------------------------------------------------------------


def _numbers(spark, sf, *more):
    return table(spark, sf, "lineitem").select(
        "l_quantity",
        F.expr("nullif(l_extendedprice, 0) + l_quantity * 10000").alias("price"),
        F.expr("case when l_linenumber <> 3 then l_quantity * 2 + l_discount end").alias("twice"),
        F.expr("-l_quantity").alias("minus"),
        "l_discount",
        "l_tax",
        F.lit(1.5).cast("double").alias("flat"),
        *more,
    )


SQL_NUMBERS = """
select l_quantity, nullif(l_extendedprice, 0) + l_quantity * 10000 as price,
       case when l_linenumber <> 3 then l_quantity * 2 + l_discount end as twice, -l_quantity as minus,
       l_discount, l_tax, 1.5::double as flat
from lineitem
"""
NUMBERS = ("l_quantity", "price", "twice", "minus", "l_discount", "l_tax", "flat")


def _sql_corr(names, source: str) -> str:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = lambda a, b: (
        f"case when isfinite(corr({a}::double, {b}::double)) then {sql_r6(f'corr({a}::double, {b}::double)')} end"
    )
    return " union all ".join(
        f"select '{a}' as col1, '{b}' as col2, {one(a, b)} as corr from ({source})" for a, b in pairs
    )


def _rounded(df):
    return df.select("col1", "col2", r6("corr").alias("corr"))


@query(_sql_corr(NUMBERS, SQL_NUMBERS))
def corr_pairs(spark, sf):
    return _rounded(correlations(_numbers(spark, sf)))


WIDE = (*NUMBERS, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
SQL_WIDE = SQL_NUMBERS.replace(
    "1.5::double as flat", "1.5::double as flat, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice"
)


def _wide(spark, sf):
    return _numbers(spark, sf, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


@query(_sql_corr(WIDE, SQL_WIDE))
def corr_pairs_wide(spark, sf):
    return _rounded(correlations(_wide(spark, sf)))


# l_quantity goes first: it has no more nulls than its partners; then price before twice.
@query(f"select twice, minus, l_discount, l_tax, flat from ({SQL_NUMBERS})")
def drop_correlated(spark, sf):
    df = _numbers(spark, sf)
    return DropCorrelated(threshold=0.7).fit(df).apply(df)


@query(f"select minus, l_discount, l_tax, flat, price from ({SQL_NUMBERS})")
def drop_correlated_fewest_nulls(spark, sf):
    df = _numbers(spark, sf)
    return DropCorrelated(threshold=0.7, prefer="fewest_nulls").fit(df).apply(df)


# -- projections --------------------------------------------------------------


@query(f'select o_totalprice from ({SQL_BASE})')
def feature_columns_drop_first(spark, sf):
    df = base(spark, sf)
    return df.select(*feature_columns(df, drop_first=True))


@query(f'select case_id as id, "WEEK_NUM" as grp, target, o_custkey, o_totalprice from ({SQL_BASE})')
def separate_parts(spark, sf):
    df = base(spark, sf)
    parts = parts_of(df)
    return df.select(
        F.col(parts["id"].columns[0]).alias("id"),
        F.col(parts["group"].columns[0]).alias("grp"),
        *parts["target"].columns,
        *parts["features"].columns,
    )


# -- chains -------------------------------------------------------------------


def _child(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("num_group1"),
        "l_quantity",
        "l_discount",
        "l_returnflag",
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("part"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"),
    )


SQL_UNIX = "datediff('day', date '1970-01-01', l_shipdate::date)"
_STEP1 = {
    "l_quantity": "l_quantity::float",
    "l_discount": "l_discount::float",
    "l_returnflag_A": "(l_returnflag = 'A')::int",
    "l_returnflag_N": "(l_returnflag = 'N')::int",
    "l_returnflag_R": "(l_returnflag = 'R')::int",
    "shipped_unix": SQL_UNIX,
}


@query(f"""
select l_orderkey as case_id, count(*)::smallint as len,
  {", ".join(f'{sql_r6(f"avg({e})::float::double")} as "mean_{c}"' for c, e in _STEP1.items())},
  {", ".join(f'{sql_r6(f"stddev_samp({e})::float::double")} as "std_{c}"' for c, e in _STEP1.items())}
from lineitem group by l_orderkey
""")
def chain_step1(spark, sf):
    out = step1()(_child(spark, sf))
    return out.select(
        "case_id", "len", *[r6(F.col(c).cast("double")).alias(c) for c in out.columns if c[:4] in ("mean", "std_")]
    )


@query(f"select *, 1::int as \"MONTH\" from ({SQL_BASE}) where false")
def chain_empty(spark, sf):
    df = base(spark, sf).withColumn("MONTH", F.lit(1)).where("case_id < 0")
    return Chain((*step2().steps, *step3().steps))(df)


def _merged(spark, sf):
    df = base(spark, sf)
    return df.withColumns(
        {
            "price_null": F.expr("case when case_id % 10 = 0 then o_totalprice end"),
            "same": F.lit(1.0),
            "price2": F.expr("case when case_id % 5 <> 0 then o_totalprice * 3 + 1 end"),
        }
    )


@query(f"""
select case_id, date_decision, "WEEK_NUM", target, o_custkey,
       case when case_id % 5 <> 0 then o_totalprice * 3 + 1 end as price2
from ({SQL_BASE})
""")
def chain_step2(spark, sf):
    return step2()(_merged(spark, sf))


@query(f"""
select case_id, date_decision, "WEEK_NUM", target, {sql_r6("(o_custkey - mc) / sc")} as o_custkey,
       {sql_r6("(o_totalprice - mp) / sp")} as o_totalprice
from ({SQL_BASE}), (select avg(o_custkey) as mc, stddev_pop(o_custkey) as sc, avg(o_totalprice) as mp,
                           stddev_pop(o_totalprice) as sp from orders)
""")
def chain_step3(spark, sf):
    out = step3()(base(spark, sf))
    return out.withColumns({c: r6(c) for c in ("o_custkey", "o_totalprice")})


CLEANED = ("id", "l_linenumber", "l_quantity", "l_discount")
CLEANING = CleaningConfig(
    remove_rows=(RowRule(("l_quantity", "l_discount"), lambda c: c > 45),),
    remove_columns=(ColumnRule(lambda s: s.min is not None and s.min == s.max),),
    replace=(ValueRule(("l_discount",), lambda c: c > 0.08, 0.08),),
)


@query("""
select l_orderkey::bigint as l_orderkey, l_quantity::bigint as l_quantity,
       case when l_discount::float > 0.08 then 0.08::double else round(l_discount, 4) + 0.0 end as l_discount,
       l_returnflag, l_shipdate::date as shipped
from lineitem where not (l_quantity > 45) and not (l_discount > 45)
""")
def clean_rows(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        "l_discount",
        "l_returnflag",
        F.date_format("l_shipdate", "dd-MM-yyyy").alias("shipped"),
        F.lit("x").alias("constant_text"),
    )
    out = tidy(df, CLEANING)
    return out.select(
        F.col("l_orderkey").cast("bigint"),
        F.col("l_quantity").cast("bigint"),
        F.round(F.col("l_discount").cast("double"), 4).alias("l_discount"),
        "l_returnflag",
        F.col("shipped").cast("date"),
    )


@query(f"""
with kept as (select l_orderkey as id, l_linenumber, l_quantity, l_returnflag as flag,
                case when l_discount::float > 0.08::float then 0.08::float else l_discount::float end as l_discount
              from lineitem where l_quantity <= 45),
  stats as (select {", ".join(f"avg({c}::double) as m_{c}, stddev_pop({c}::double) as s_{c}" for c in CLEANED)} from kept)
select {", ".join(f"(round((({c}::double - m_{c}) / s_{c})::float::double, 4) + 0.0) as {c}" for c in CLEANED)}, flag
from kept, stats
""")
def clean_job_numeric(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    config = replace(CLEANING, encode=False, rename={"l_orderkey": "id", "l_returnflag": "flag"})
    out = clean(df, config).table
    return out.select(*[F.round(F.col(c).cast("double"), 4).alias(c) for c in CLEANED], "flag")


@query()
def clean_job(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    result = clean(df, CLEANING)
    saved = F.lit(result.saved_percent).alias("saved_percent")
    numeric = [f.name for f in result.table.schema.fields if is_numeric(f.dataType)]
    return result.table.select(*[r6(F.col(c).cast("double")).alias(c) for c in numeric], saved)


@query(f"select * exclude (rare, empty, customer) from ({SQL_FEATURES})")
def chain_of_functions(spark, sf):
    chain = Chain(
        (
            DropNullHeavy(threshold=0.95),
            lambda df: df.drop("customer"),
            DropHighCardinality(threshold=11),
        )
    )
    return chain(_features(spark, sf))


@query("""
select o_orderkey, o_custkey, o_orderstatus from orders
""")
def narrowed_chain(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.concat(F.lit("K"), F.col("o_orderkey").cast("string")).alias("k")
    )
    out = Chain((Narrow(), DropHighCardinality(threshold=11)))(df)
    return out.withColumns({c: F.col(c).cast(T.LongType()) for c in ("o_orderkey", "o_custkey")})
