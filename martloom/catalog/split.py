"""Splits, samples and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from martloom.catalog.common import SQL_BASE, SQL_SCORED, base, query, scored, sql_hash, sql_order, table
from martloom.functions.hashing import order_hash
from martloom.operators.splits import (
    expanding_folds,
    folds,
    group_split,
    ladder,
    ladder_sample,
    ratio_split,
    shuffled,
    stratified_folds,
    stratified_sample,
)


def _ranked(source: str, key: str, seed: int, strata: str = "") -> str:
    part = f"partition by {strata} " if strata else ""
    return f"""select *, row_number() over ({part}order by {sql_order(key, seed)}) as rn,
      count(*) over ({f"partition by {strata}" if strata else ""}) as n from ({source})"""


def _sql_ratio(source: str, key: str, strata: str = "") -> str:
    """A 5:3:2 split: ceil(n / 2) rows are held out, ceil(2 / 5) of those are for the test."""
    return f"""
    select * exclude (rn, n, held, tested),
      case when rn <= n - held then 'train' when rn <= n - tested then 'valid' else 'test' end as split
    from (select *, ceil(held * 2 / 5) as tested
          from (select *, ceil(n * 5 / 10) as held from ({_ranked(source, key, 42, strata)})))"""


@query(_sql_ratio("select o_orderkey, o_totalprice from orders", "o_orderkey"))
def ratio_split_exact(spark, sf):
    return ratio_split(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "5:3:2", "o_orderkey")


@query(f"""
select event_id, case when b < 6 then 'train' when b < 8 then 'valid' else 'test' end as split
from (select event_id, {sql_hash("event_id", 42)} % 10 as b from events)
""")
def ratio_split_hashed(spark, sf):
    return ratio_split(table(spark, sf, "events").select("event_id"), "6:2:2", "event_id", exact=False)


@query(_sql_ratio("select event_id, nullif(event_type, 'view') as event_type from events", "event_id", "event_type"))
def ratio_split_stratified(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.expr("nullif(event_type, 'view')").alias("event_type"))
    return ratio_split(df, "5:3:2", "event_id", stratify="event_type")


@query(f"""
with k as (select l_orderkey, row_number() over (order by {sql_order("l_orderkey", 1)}) as rn, count(*) over () as n
           from (select distinct l_orderkey from lineitem)),
  s as (select l_orderkey, case when rn <= floor(n * 6 / 10) then 'train'
          when rn <= floor(n * 6 / 10) + floor((n - floor(n * 6 / 10)) / 2) then 'valid' else 'test' end as split from k)
select l.l_orderkey, l_linenumber, l_quantity, split from lineitem l join s on s.l_orderkey = l.l_orderkey
""")
def group_split_exact(spark, sf):
    return group_split(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey")


@query(f"""
select l_orderkey, l_linenumber, case when b < 6 then 'train' when b < 8 then 'valid' else 'test' end as split
from (select l_orderkey, l_linenumber, {sql_hash("l_orderkey", 1)} % 10 as b from lineitem)
""")
def group_split_hashed(spark, sf):
    return group_split(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", exact=False)


@query(f"""
select event_id, event_type from ({_ranked("select event_id, event_type from events", "event_id", 42, "event_type")})
where rn <= floor(n * 0.3::double)
""")
def sample_stratified(spark, sf):
    return stratified_sample(table(spark, sf, "events").select("event_id", "event_type"), "event_type", 0.3, "event_id")


@query("""
with n as (select count(*) as n, count(*) * 12 * 2 / 1048576.0 as mb from lineitem),
  c as (select n, case when mb <= 0.25 then 1 else 2 ** ceil(log2(mb / 0.25)) end as coefficient from n),
  s as (select n, floor(n / coefficient)::bigint as small from c)
select 'small' as rung, small as n_rows from s
union all select 'medium', floor(sqrt(n * small))::bigint from s
union all select 'full', n from s
""")
def size_rungs(spark, sf):
    sizes = ladder(table(spark, sf, "lineitem").count(), n_features=12, limit_mb=0.25)
    rows = [(r, getattr(sizes, r)) for r in ("small", "medium", "full")]
    return spark.createDataFrame(rows, "rung string, n_rows bigint")


@query(f"""
with z as (select count(*) as total, count(*) * 12 * 2 / 1048576.0 as mb from events),
  s as (select total, floor(total / case when mb <= 0.05 then 1 else 2 ** ceil(log2(mb / 0.05)) end) as small from z)
select event_id, event_type from
  ({_ranked("select event_id, event_type from events", "event_id", 42, "event_type")}), s
where rn <= floor(n * (small::double / total))
""")
def rung_sample(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type")
    return ladder_sample(df, "small", "event_type", "event_id", n_features=12, limit_mb=0.05)


SQL_FOLD = " + ".join(f"(rn > floor(n * {i} / 5))::int" for i in range(1, 5))


@query(f"select event_id, {SQL_FOLD} as fold from ({_ranked('select event_id from events', 'event_id', 42)})")
def folds_plain(spark, sf):
    return folds(table(spark, sf, "events").select("event_id"), 5, "event_id")


@query(f"""
select event_id, event_type, {SQL_FOLD} as fold
from ({_ranked("select event_id, event_type from events", "event_id", 42, "event_type")})
""")
def folds_stratified(spark, sf):
    return stratified_folds(table(spark, sf, "events").select("event_id", "event_type"), "event_type", 5, "event_id")


@query(f"select event_id, ({sql_hash('event_id', 42)} % 5)::int as fold from events")
def folds_hashed(spark, sf):
    return folds(table(spark, sf, "events").select("event_id"), 5, "event_id", exact=False)


@query(f"""
select (row_number() over (order by period) - 1)::int as fold, period as test_period,
       (sum(n) over (order by period rows between unbounded preceding and 1 preceding))::bigint as n_train, n as n_test
from (select period, count(*) as n from ({SQL_SCORED}) group by period) qualify fold >= 1
""")
def folds_expanding(spark, sf):
    return expanding_folds(scored(spark, sf), "period")


@query(f"select case_id, {sql_hash('case_id', 1)} as place from ({SQL_BASE}) order by place, case_id")
def shuffled_keys(spark, sf):
    keys = base(spark, sf).select("case_id")
    return shuffled(keys, "case_id").select("case_id", order_hash("case_id", 1).alias("place"))
