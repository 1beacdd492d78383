"""Registration and the derived tables that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives its result."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql.strip()
        return function

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def sql_r6(e: str) -> str:
    """The same rounding in SQL, without negative zeros."""
    return f"(round({e}, 6) + 0.0)"


def sql_hash(key: str, seed: int) -> str:
    return f"('0x' || substr(md5(concat_ws('|', ({key})::varchar, '{seed}')), 1, 15))::bigint"


def sql_order(key: str, seed: int) -> str:
    return f"{sql_hash(key, seed)}, {key}"


# -- base table of the mart ---------------------------------------------------


def base(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in the role of the base table."""
    days = F.unix_date(F.col("o_orderdate").cast("date")) - F.unix_date(F.lit("1995-01-01").cast("date"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_orderdate").cast("date").alias("date_decision"),
        F.floor(days / 7).cast("int").alias("WEEK_NUM"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"),
        F.col("o_custkey"),
        F.col("o_totalprice"),
    )


SQL_BASE = """
  select o_orderkey as case_id, o_orderdate::date as date_decision,
         floor(datediff('day', date '1995-01-01', o_orderdate::date) / 7)::int as "WEEK_NUM",
         (o_orderstatus = 'F')::int as target, o_custkey, o_totalprice
  from orders
"""

# -- scored rows --------------------------------------------------------------


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Events as scored rows: purchases are the positives, the value is the score."""
    return table(spark, sf, "events").select(
        "event_id",
        F.col("ts").cast("date").alias("period"),
        (F.col("event_type") == "purchase").cast("int").alias("target"),
        F.col("value").alias("score"),
    )


SQL_SCORED = """
  select event_id, ts::date as period, (event_type = 'purchase')::int as target, value as score from events
"""


def sql_auc(source: str, by: tuple[str, ...] = (), score: str = "score", target: str = "target") -> str:
    """AUC per group by counting, for every positive, the negatives below it."""
    g = ", ".join(by)
    lead = g + ", " if g else ""
    part = f"partition by {g} " if g else ""
    group = f"group by {g}" if g else ""
    return f"""
      select {lead}
             sum(pos * (coalesce(below, 0) + neg / 2.0)) / nullif(sum(pos)::double * sum(neg), 0) as auc
      from (
        select *, sum(neg) over ({part}order by s rows between unbounded preceding and 1 preceding) as below
        from (
          select {lead}{score} as s, count(*) filter ({target} = 1)::double as pos,
                 count(*) filter ({target} <> 1)::double as neg
          from ({source}) group by {lead}s
        )
      ) {group}
    """


def sql_metrics(source: str) -> str:
    """Accuracy and macro scores per `set` of rows (set, y, p), counted class by class."""
    return f"""
      select c.set, any_value(a.accuracy) as accuracy,
        avg(case when actual + predicted > 0 then 2.0::double * tp / (actual + predicted) else 0 end) as f1,
        avg(case when predicted > 0 then tp * 1.0::double / predicted else 0 end) as precision,
        avg(case when actual > 0 then tp * 1.0::double / actual else 0 end) as recall
      from (
        select k.set, k.label, count(*) filter (d.y = k.label and d.p = k.label) as tp,
               count(*) filter (d.y = k.label) as actual, count(*) filter (d.p = k.label) as predicted
        from (select distinct set, unnest([y, p]) as label from ({source})) k
        join ({source}) d on d.set = k.set group by k.set, k.label
      ) c join (select set, avg((y = p)::int) as accuracy from ({source}) group by set) a on a.set = c.set
      group by c.set
    """


# -- predictions of three models ----------------------------------------------

MODELS = ["m1", "m2", "m3"]


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three score columns per event beside a label and a numeric target."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("key"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        (F.col("value") + 1.0).alias("target"),
        F.col("value").alias("m1"),
        (F.col("user_id") % 100).cast("double").alias("m2"),
        k.alias("m3"),
    )


SQL_PREDICTIONS = """
  select event_id as key, (event_type = 'purchase')::int as y, value + 1.0::double as target,
         value as m1, (user_id % 100)::double as m2, (props::json->>'$.k')::double as m3
  from events
"""
