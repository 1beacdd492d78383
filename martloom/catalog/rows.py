"""Ingest, contracts, row cleaning and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.catalog.common import query, r6, sql_r6, table
from martloom.operators.filters import FillBelowMin, align, remove_rows, replace_values
from martloom.operators.narrowing import fit_narrowing
from martloom.operators.profile import profile, table_bytes
from martloom.operators.scaling import Scale, zscore
from martloom.session import scratch_path
from martloom.sources.contract import Contract, Field
from martloom.sources.tables import (
    Source,
    ingest,
    materialise,
    matching_paths,
    read_parts,
    snapshot,
    table_paths,
    write_stage,
)

ORDERS = Contract(
    (
        Field("o_orderkey", T.LongType(), ge=0),
        Field("o_orderstatus", T.StringType(), isin=("F", "O")),
        Field("o_totalprice", T.DoubleType(), nullable=True, ge=5000.0, le=450000.0),
        Field("referrer", T.LongType()),
        Field("agent", T.LongType(), nullable=True, le=80),
        Field("o_shippriority", T.IntegerType()),
        Field("o_orderpriority", T.LongType()),
    )
)


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        "*",
        F.expr("nullif(o_custkey % 10, 0)").alias("referrer"),
        F.expr("nullif(o_orderkey % 90, 0)").alias("agent"),
    )


SQL_ORDERS = "select *, nullif(o_custkey % 10, 0) as referrer, nullif(o_orderkey % 90, 0) as agent from orders"


def _sql_check(column: str, check: str, bad: str) -> str:
    return f"""select '{column}' as "column", '{check}' as "check",
      count(*) filter (where {bad}) as n_bad, count(*) as n_rows from ({SQL_ORDERS})"""


@query(
    " union all ".join(
        _sql_check(*c)
        for c in (
            ("o_orderkey", "not_null", "o_orderkey is null"),
            ("o_orderkey", "ge", "o_orderkey < 0"),
            ("o_orderstatus", "not_null", "o_orderstatus is null"),
            ("o_orderstatus", "isin", "o_orderstatus not in ('F', 'O')"),
            ("o_totalprice", "ge", "o_totalprice < 5000"),
            ("o_totalprice", "le", "o_totalprice > 450000"),
            ("referrer", "not_null", "referrer is null"),
            ("agent", "le", "agent > 80"),
            ("o_shippriority", "present", "true"),
            ("o_orderpriority", "type", "true"),
        )
    )
)
def contract_violations(spark, sf):
    return ORDERS.report(_orders(spark, sf))


@query(f"""
select o_orderkey, o_orderstatus, o_totalprice, referrer, agent from ({SQL_ORDERS})
where o_orderstatus not in ('F', 'O') or o_totalprice < 5000 or o_totalprice > 450000
   or referrer is null or agent > 80
""")
def contract_quarantine(spark, sf):
    _, bad = ORDERS.split(_orders(spark, sf))
    return bad.select("o_orderkey", "o_orderstatus", "o_totalprice", "referrer", "agent")


def _customer_source(sf):
    return Source(
        "customers",
        params={"path": f"{sf}/customer.parquet"},
        contract=Contract((Field("c_custkey", T.LongType(), ge=0), Field("c_mktsegment", T.StringType()))),
        columns=("c_mktsegment", "c_custkey", "c_acctbal"),
        casts={"c_acctbal": lambda c: F.floor(c).cast("bigint"), "c_mktsegment": F.lower},
    )


SQL_CUSTOMERS = """
select lower(c_mktsegment) as c_mktsegment, c_custkey, floor(c_acctbal)::bigint as c_acctbal from customer
"""


@query(SQL_CUSTOMERS)
def ingest_project_cast(spark, sf):
    return _customer_source(sf).read(spark)


@query(SQL_CUSTOMERS)
def snapshot_roundtrip(spark, sf):
    return ingest(spark, [_customer_source(sf)], scratch_path(spark, "ingest"))["customers"]


def _write_parts(spark, sf):
    """Lineitem as three parts whose schemas differ in a type and in a column."""
    root = scratch_path(spark, "parts")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    a = items.where("l_returnflag = 'A'").withColumn("l_linenumber", F.col("l_linenumber").cast("string"))
    n = items.where("l_returnflag = 'N'").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))
    r = items.where("l_returnflag = 'R'").drop("l_quantity")
    for i, part in enumerate((a, n, r)):
        snapshot(part, root, f"items_{i}.parquet")
    return f"{root}/items_*.parquet"


SQL_PARTS = """
select l_orderkey, l_linenumber::varchar as l_linenumber,
       case when l_returnflag <> 'R' then l_quantity end as l_quantity, l_returnflag from lineitem
"""


@query(SQL_PARTS)
def multi_file_scan(spark, sf):
    return read_parts(spark, _write_parts(spark, sf)).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("""
select l_returnflag, l_orderkey, count(*) as n, max(l_linenumber)::bigint as last_line
from lineitem group by l_returnflag, l_orderkey
""")
def multi_file_scan_per_file(spark, sf):
    def per_part(df):
        return df.groupBy("l_orderkey", "l_returnflag").agg(
            F.count("*").alias("n"), F.max(F.col("l_linenumber").cast("bigint")).alias("last_line")
        )

    return read_parts(spark, _write_parts(spark, sf), per_part, per_file=True).select(
        "l_returnflag", "l_orderkey", "n", "last_line"
    )


@query("select c_mktsegment, count(*) as n from customer group by c_mktsegment")
def materialise_if_absent(spark, sf):
    path = scratch_path(spark, "materialised")
    build = lambda: table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    materialise(spark, path, build)
    # The second call must find the first one's table and not build this one.
    return materialise(spark, path, lambda: table(spark, sf, "customer").select("c_mktsegment"))


@query("select c_mktsegment, count(*) as n from customer group by c_mktsegment")
def materialise_csv(spark, sf):
    path = scratch_path(spark, "materialised-csv")
    counts = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return materialise(spark, path, lambda: counts, format="csv").select("c_mktsegment", F.col("n").cast("bigint"))


@query("""
select 'ingest' as stage, 'orders' as "table", count(*) as n_rows, 6 as n_cols from orders
union all select 'preprocess', 'lineitem', count(*), 11 from lineitem
""")
def stage_handoff(spark, sf):
    root = scratch_path(spark, "stages")
    a = write_stage(table(spark, sf, "orders"), f"{root}/orders", "ingest", "orders")
    b = write_stage(table(spark, sf, "lineitem"), f"{root}/lineitem", "preprocess", "lineitem")
    return a.unionByName(b)


@query("""
select 'base' as name, count(*) as n_rows from orders
union all select 'static_0', count(*) from customer
union all select 'person_1', count(*) from lineitem
""")
def source_catalogue(spark, sf):
    root = scratch_path(spark, "catalogue")
    copies = {"base": "orders", "person_1": "lineitem"}
    for name, source in copies.items():
        snapshot(table(spark, sf, source), f"{root}/train", f"train_{name}.parquet")
    customers = table(spark, sf, "customer")
    snapshot(customers.where("c_acctbal < 0"), f"{root}/train", "train_static_0_0.parquet")
    snapshot(customers.where("c_acctbal >= 0"), f"{root}/train", "train_static_0_1.parquet")
    out = None
    for name, path in table_paths(root, "train").items():
        if matching_paths(spark, path):
            n = read_parts(spark, path).agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"))
            out = n if out is None else out.unionByName(n)
    return out


def _sql_width(column: str) -> str:
    return f"case when max({column}) <= 255 then 2 when max({column}) <= 65535 then 4 else 8 end"


@query(f"""
select (count(*) * 32 + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority)))::bigint as bytes_before,
       (count(*) * ({_sql_width("o_orderkey")} + {_sql_width("o_custkey")} + 4 + 8)
        + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority)))::bigint as bytes_after
from orders
""")
def size_report(spark, sf):
    df = table(spark, sf, "orders")
    before = profile(df, want=("bytes",))
    narrow = {f.name: f.dataType for f in fit_narrowing(df).apply(df).schema.fields}
    return spark.createDataFrame(
        [(table_bytes(before), table_bytes(before, narrow))], "bytes_before bigint, bytes_after bigint"
    )


# -- row cleaning -------------------------------------------------------------


def _null_items(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr("nullif(l_quantity, 7)").alias("qty"), "l_discount", "l_returnflag"
    )


SQL_NULL_ITEMS = """
select l_orderkey, l_linenumber, nullif(l_quantity, 7) as qty, l_discount, l_returnflag from lineitem
"""


@query(f"""
select * from ({SQL_NULL_ITEMS}) where not coalesce(qty > 40, false) and not coalesce(l_discount > 40, false)
""")
def remove_rows_where(spark, sf):
    return remove_rows(_null_items(spark, sf), ["qty", "l_discount"], lambda c: c > 40)


@query(f"""
select l_orderkey, l_linenumber, case when qty < 10 then -1.0 else qty end as qty,
       case when l_discount < 10 then -1.0 else l_discount end as l_discount, l_returnflag
from ({SQL_NULL_ITEMS})
""")
def replace_values_where(spark, sf):
    return replace_values(_null_items(spark, sf), ["qty", "l_discount"], lambda c: c < 10, -1.0)


@query("select c_custkey as id, c_mktsegment as segment, c_acctbal from customer")
def rename_columns(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return df.withColumnsRenamed({"c_custkey": "id", "c_mktsegment": "segment"})


@query(f"""
select l_orderkey, l_linenumber, coalesce(qty, (select min(l_quantity) - 100000 from lineitem where l_quantity <> 7))
       as qty, l_discount, l_returnflag from ({SQL_NULL_ITEMS})
""")
def fill_below_min(spark, sf):
    df = _null_items(spark, sf)
    return FillBelowMin().fit(df).apply(df)


@query("""
select o_orderkey, null::double as l_tax, 1.0::double as kind_null, o_totalprice from orders
""")
def align_schema(spark, sf):
    return align(table(spark, sf, "orders"), ["o_orderkey", "l_tax", "kind_null", "o_totalprice"])


# -- scaling ------------------------------------------------------------------

SCALED = ("l_quantity", "l_extendedprice", "l_discount", "flat")


def _scalable(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
        F.expr("nullif(l_quantity, 7)").alias("l_quantity"),
        "l_extendedprice",
        "l_discount",
        F.lit(3.0).alias("flat"),
    )


SQL_SCALABLE = """
select l_orderkey, l_linenumber, l_shipdate, nullif(l_quantity, 7) as l_quantity, l_extendedprice, l_discount,
       3.0::double as flat from lineitem
"""


def _sql_stats(where: str = "true", deviation: str = "stddev_pop") -> str:
    parts = [
        f"avg({c}) as m_{c}, case when {deviation}({c}) > 0 then {deviation}({c}) else 1 end as s_{c}" for c in SCALED
    ]
    return f"select {', '.join(parts)} from ({SQL_SCALABLE}) where {where}"


def _sql_scaled(where: str, fit: str = "true") -> str:
    cols = ", ".join(f"{sql_r6(f'({c} - m_{c}) / s_{c}')} as {c}" for c in SCALED)
    return f"select l_orderkey, l_linenumber, {cols} from ({SQL_SCALABLE}), ({_sql_stats(fit)}) where {where}"


def _rounded(df):
    return df.select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in SCALED])


@query(_sql_scaled("true"))
def scale_standard(spark, sf):
    df = _scalable(spark, sf)
    return _rounded(Scale(ignore=("l_orderkey", "l_linenumber")).fit(df).apply(df))


@query(_sql_scaled("l_shipdate >= timestamp '1999-01-01'", "l_shipdate < timestamp '1999-01-01'"))
def scale_apply_other(spark, sf):
    df = _scalable(spark, sf)
    day = F.lit("1999-01-01").cast("date")
    plan = Scale(ignore=("l_orderkey", "l_linenumber")).fit(df.where(F.col("l_shipdate") < day))
    return _rounded(plan.apply(df.where(F.col("l_shipdate") >= day)))


@query(f"""
select {", ".join(f"{sql_r6(f'(x.{c} - m_{c}) / s_{c}')} as {c}" for c in ("c_custkey", "c_acctbal"))}
from customer x, (select avg(c_custkey) as m_c_custkey, stddev_samp(c_custkey) as s_c_custkey,
                         avg(c_acctbal) as m_c_acctbal, stddev_samp(c_acctbal) as s_c_acctbal from customer)
""")
def zscore_columns(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_name")
    return zscore(df).select(*[r6(F.col(c)).alias(c) for c in ("c_custkey", "c_acctbal")])


@query(f"""
select l_orderkey, l_linenumber, {sql_r6("(l_discount * 2) * s_l_extendedprice + m_l_extendedprice")} as target
from ({SQL_SCALABLE}), ({_sql_stats()})
""")
def inverse_scale(spark, sf):
    df = _scalable(spark, sf)
    plan = Scale(ignore=("l_orderkey", "l_linenumber")).fit(df)
    prediction = F.col("l_discount") * 2
    return df.select("l_orderkey", "l_linenumber", r6(plan.inverse(prediction, "l_extendedprice")).alias("target"))
