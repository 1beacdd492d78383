"""Aggregation, joins, unions and the feature mart."""

from __future__ import annotations

from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from martloom.catalog.common import SQL_BASE, base, query, r6, sql_order, sql_r6, table
from martloom.operators.aggregation import Aggregate, label_counts
from martloom.operators.combine import distinct_keys, keep_keys, merge_features, union_relaxed
from martloom.operators.encoding import fit_dates
from martloom.plans.mart import build_mart
from martloom.plans.steps import IGNORE
from martloom.session import scratch_path, side_by_side
from martloom.sources.tables import snapshot

STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def _items(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.expr("nullif(l_orderkey % 1000, 0)").alias("case_id"),
        F.col("l_linenumber").alias("num_group1"),
        F.expr("nullif(l_quantity, 7)").alias("quantity"),
        "l_extendedprice",
        "l_returnflag",
    )


SQL_AGG_ITEMS = """
select nullif(l_orderkey % 1000, 0) as case_id, l_linenumber as num_group1, nullif(l_quantity, 7) as quantity,
       l_extendedprice, l_returnflag from lineitem
"""


@query(f"""
select case_id, count(*) as len, {", ".join(
    f"{sql_r6(f'{f}({c})')} as {k}_{c}" for k, f in STATS.items() for c in ("quantity", "l_extendedprice"))}
from ({SQL_AGG_ITEMS}) group by case_id
""")
def aggregate_by_key(spark, sf):
    df = _items(spark, sf)
    out = Aggregate("case_id", IGNORE, tuple(STATS)).plan(df).apply(df)
    return out.select("case_id", "len", *[r6(c).alias(c) for c in out.columns[2:]])


@query("select * from customer")
def aggregate_skip_unique(spark, sf):
    df = table(spark, sf, "customer")
    return Aggregate("c_custkey").fit(df).apply(df)


@query(f"""
select case_id, count(*)::int as len, {", ".join(
    f"{sql_r6(f'{f}({c})::float::double')} as {k}_{c}"
    for k, f in (("mean", "avg"), ("std", "stddev_samp")) for c in ("quantity", "l_extendedprice"))}
from ({SQL_AGG_ITEMS}) group by case_id
""")
def aggregate_narrow(spark, sf):
    _, out = Aggregate("case_id", IGNORE).fit_apply(_items(spark, sf))
    return out.select(
        "case_id",
        F.col("len").cast("int").alias("len"),
        *[r6(F.col(c).cast("double")).alias(c) for c in out.columns[2:]],
    )


@query("select quality, count(*) as n from labels group by quality")
def label_count(spark, sf):
    return label_counts(table(spark, sf, "labels"), "quality")


@query("select * from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_join_keys(spark, sf):
    keys = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return keep_keys(table(spark, sf, "orders"), keys, "o_custkey")


@query("select distinct l_orderkey from lineitem")
def distinct_key(spark, sf):
    return distinct_keys(table(spark, sf, "lineitem"), "l_orderkey")


@query("""
select c_custkey as id, c_nationkey::varchar as nation, c_acctbal as balance, c_mktsegment as segment, null as name
from customer
union all select s_suppkey, 'N' || s_nationkey::varchar, floor(s_acctbal), null, s_name from supplier
""")
def union_widening(spark, sf):
    customers = table(spark, sf, "customer").selectExpr(
        "cast(c_custkey as int) as id", "c_nationkey as nation", "c_acctbal as balance", "c_mktsegment as segment"
    )
    suppliers = table(spark, sf, "supplier").selectExpr(
        "s_suppkey as id",
        "concat('N', s_nationkey) as nation",
        "cast(floor(s_acctbal) as int) as balance",
        "s_name as name",
    )
    return union_relaxed([customers, suppliers])


# -- feature mart -------------------------------------------------------------

SQL_ITEM_AGG = f"""
select l_orderkey as case_id, count(*) as len, {", ".join(
    f"{f}({c}) as {k}_{c}" for k, f in (("mean", "avg"), ("std", "stddev_samp")) for c in ("l_quantity", "l_tax"))}
from lineitem group by l_orderkey
"""
SQL_RETURNS = """
select l_orderkey as case_id, count(*) as len, avg(l_quantity) as mean_l_quantity,
       stddev_samp(l_quantity) as std_l_quantity
from lineitem where l_returnflag = 'R' group by l_orderkey
"""
ITEM_STATS = ("mean_l_quantity", "mean_l_tax", "std_l_quantity", "std_l_tax")


def mart(spark, sf):
    """Orders with aggregated lineitems: narrow, aggregate, join, date feature."""
    orders = base(spark, sf)
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_quantity", "l_tax")
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("case_id"), "l_quantity"
    )
    stage = Aggregate("case_id", IGNORE)
    empty = items.where("case_id < 0")
    tables = [stage.plan(items).apply(items), empty, stage.plan(returned).apply(returned)]
    merged = merge_features(orders, tables, "case_id", [False, True, False])
    return fit_dates(merged).apply(merged)


@query(f"""
select b.case_id, "WEEK_NUM", target, o_custkey, o_totalprice,
       a.len, {", ".join(f"{sql_r6('a.' + c)} as {c}" for c in ITEM_STATS)},
       r.len as len_2, {sql_r6("r.mean_l_quantity")} as mean_l_quantity_2,
       {sql_r6("r.std_l_quantity")} as std_l_quantity_2,
       datediff('day', date '1970-01-01', date_decision)::int as date_decision_unix
from ({SQL_BASE}) b left join ({SQL_ITEM_AGG}) a on a.case_id = b.case_id
left join ({SQL_RETURNS}) r on r.case_id = b.case_id
""")
def feature_mart(spark, sf):
    out = mart(spark, sf)
    return out.withColumns({c: r6(c) for c in out.columns if c.startswith(("mean_", "std_"))}).withColumn(
        "date_decision_unix", F.col("date_decision_unix").cast("int")
    )


def write_sources(spark, sf, splits=("train",)):
    """The driver tables laid out as the source files of a mart."""
    root = scratch_path(spark, "sources")
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("num_group1"),
        "l_quantity",
        "l_returnflag",
        "l_shipdate",
    )
    items = items.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    orders = base(spark, sf).withColumn("date_decision", F.date_format("date_decision", "yyyy-MM-dd"))
    static = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderpriority", "o_totalprice")
    low, high = static.where("o_totalprice < 200000"), static.where("o_totalprice >= 200000")
    sources = {"person_1": items, "base": orders, "static_0_0": low, "static_0_1": high}
    works = [
        partial(snapshot, df, f"{root}/{split}", f"{split}_{name}.parquet")
        for split in splits
        for name, df in sources.items()
    ]
    side_by_side(spark, works)
    return root


TABLES = ("base", "static_0_*", "person_1")


# Features: 3 of the base, the price and 5 priorities of the static table, the length and
# mean and deviation of 5 columns of the child table.
@query(f"""
with ranked as (select *, row_number() over (order by {sql_order("case_id", 1)}) as rn, count(*) over () as n
                from ({SQL_BASE})),
  placed as (select *, floor(n * 6 / 10) as train from ranked),
  sets as (select *, case when rn <= train then 'train' when rn <= train + floor((n - train) / 2) then 'valid'
                     else 'test' end as split from placed)
select s.case_id, split, target::smallint as target, (3 + 1 + 5 + 1 + 2 * 5)::int as n_features,
       {sql_r6("o_totalprice::float::double")} as price, len::double as len,
       {sql_r6("mean_l_quantity::float::double")} as mean_quantity
from sets s left join ({SQL_ITEM_AGG}) a on a.case_id = s.case_id
""")
def preprocess_job(spark, sf):
    result = build_mart(spark, write_sources(spark, sf), scratch_path(spark, "mart"), TABLES, with_test=False)
    values = F.transform(vector_to_array("features"), lambda x: F.nanvl(x, F.lit(None)))
    return result.train.select(
        "case_id",
        "split",
        "target",
        F.size(values).alias("n_features"),
        r6(values[1]).alias("price"),
        values[9].alias("len"),
        r6(values[10]).alias("mean_quantity"),
    )


@query(f"""
select b.case_id, "WEEK_NUM", {sql_r6("o_totalprice::float::double")} as o_totalprice, len::double as len,
       {sql_r6("mean_l_quantity::float::double")} as mean_l_quantity
from ({SQL_BASE}) b left join ({SQL_ITEM_AGG}) a on a.case_id = b.case_id
""")
def preprocess_scoring_table(spark, sf):
    """The test split of the job, aligned to the training columns."""
    root = write_sources(spark, sf, ("train", "test"))
    result = build_mart(spark, root, scratch_path(spark, "mart"), TABLES)
    return result.test.select(
        F.col("case_id").cast("bigint"),
        F.col("WEEK_NUM").cast("int"),
        r6(F.col("o_totalprice").cast("double")).alias("o_totalprice"),
        F.col("len").cast("double").alias("len"),
        r6(F.col("mean_l_quantity").cast("double")).alias("mean_l_quantity"),
    )

