"""Columns of many values and tables of many columns."""

import datetime
from threading import Barrier

import numpy as np
import pytest
from pyspark.sql import functions as F

from martloom.functions.dates import parse_date
from martloom.operators import aggregation
from martloom.operators.aggregation import Aggregate
from martloom.operators.encoding import Encode, EncodeNarrow, ReduceBooleans, SparseOneHot
from martloom.operators.filters import DropHighCardinality
from martloom.operators.narrowing import Narrow, fit_narrowing
from martloom.operators.plan import Identity
from martloom.operators.profile import column_profile, column_sketches, distinct_counts, merge_sketches, profile, sketch_counts
from martloom.plans import mart
from martloom.plans.chain import Chain
from martloom.plans.mart import process_tables


def flags_of(df, plan):
    sparse = plan.apply(df)
    got = sparse.select("id", F.unwrap_udt(plan.output).alias("v")).collect()
    names = {r.position: (r.column, r.value) for r in plan.positions().collect()}
    assert all(r.v["size"] == len(names) == sum(plan.sizes) for r in got)
    return {r.id: {names[i] for i in r.v["indices"]} for r in got}


def test_sparse_flags_name_every_value(spark):
    rows = [(i, f"v{i % 7}" if i % 5 else None, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a string, b int")
    plan = SparseOneHot(("a", "b"), "f").fit(df)
    assert plan.sizes == (8, 3) and plan.apply(df).columns == ["id", "f"]
    assert flags_of(df, plan) == {i: {("a", a), ("b", str(b))} for i, a, b in rows}
    # A value that was not learned, and a null where none was, set no flag.
    new = spark.createDataFrame([(1, "new", 2), (2, "v1", None), (3, "new", None)], "id int, a string, b int")
    assert flags_of(new, plan) == {1: {("b", "2")}, 2: {("a", "v1")}, 3: set()}


def test_sparse_flags_of_a_wide_column_stay_off_the_driver(spark):
    df = spark.range(50_000).select("id", F.concat(F.lit("text "), F.col("id")).alias("a"))
    plan = SparseOneHot(("a",)).fit(df)
    assert plan.sizes == (50_000,)
    found = plan.apply(df).select("id", F.unwrap_udt("flags")["indices"].alias("i"))
    assert found.where("size(i) <> 1").count() == 0 and found.select(F.explode("i")).distinct().count() == 50_000


def test_sparse_flags_have_no_attribute_each(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("text "), F.col("id")).alias("a"))
    out = SparseOneHot(("a",)).fit(df).apply(df)
    assert out.columns == ["id", "flags"]
    assert out.schema["flags"].metadata == {"ml_attr": {"num_attrs": 5000}}
    # The row is a vector to its users, and sparse however few flags there are.
    assert out.first()["flags"].size == 5000
    few = spark.createDataFrame([(1, "x"), (2, "y")], "id int, a string")
    assert {r.id: list(r.flags.indices) for r in SparseOneHot(("a",)).fit(few).apply(few).collect()} == {1: [0], 2: [1]}


def test_distinct_counts_without_expand(spark):
    rows = [(i % 3, None if i % 2 else float(i % 5), "a" if i else None, None, float("nan")) for i in range(40)]
    df = spark.createDataFrame(rows, "x int, y double, z string, w string, q double")
    assert {r.place: r.n_distinct for r in distinct_counts(df).collect()} == {0: 3, 1: 5, 2: 1, 3: 0, 4: 0}
    assert "Expand" not in distinct_counts(df)._jdf.queryExecution().toString()
    found = {r.column: (r.n_rows, r.n_null, r.n_distinct) for r in column_profile(df).collect()}
    assert found == {"x": (40, 0, 3), "y": (40, 20, 5), "z": (40, 1, 1), "w": (40, 40, 0), "q": (40, 40, 0)}
    empty = {r.column: (r.n_rows, r.n_distinct) for r in column_profile(df.limit(0)).collect()}
    assert empty == dict.fromkeys("xyzwq", (0, 0))
    assert {r.column: r.n_distinct for r in column_profile(df, exact=False).collect()}["x"] == 3


def test_profile_of_many_columns(spark):
    df = spark.range(50).select("id", *[(F.col("id") % (i % 40 + 1)).alias(f"c{i}") for i in range(954)])
    found = {r.column: r.n_distinct for r in column_profile(df).collect()}
    assert len(found) == 955 and all(found[f"c{i}"] == i % 40 + 1 for i in range(954))


def test_sketches_of_parts_are_those_of_the_whole(spark):
    df = spark.range(3000).selectExpr("id % 1000 as a", "string(id % 10) as b", "nullif(id % 4, 0) / 2 as c")
    parts = [column_sketches(df.where(F.col("a") % 3 == i)) for i in range(3)]
    merged = sketch_counts(merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]))).collect()
    found = {r.column: (r.n_rows, r.n_null, r.n_distinct) for r in merged}
    assert found["b"] == (3000, 0, 10) and found["c"] == (3000, 750, 3)
    assert abs(found["a"][2] - 1000) < 50


def test_encode_narrow_is_the_filter_and_the_encoding(spark):
    rows = [(i, f"k{i % 3}", f"w{i}" if i % 9 else None, f"x{i % 14}", datetime.date(2024, 1, 1 + i % 9)) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, few string, wide string, kept string, day date")
    marked = Narrow().fit(df).apply(df)
    one = EncodeNarrow(11, ("kept",)).fit(marked).apply(marked)
    two = Chain((DropHighCardinality(11, ("kept",)), Encode()))(marked)
    assert one.columns == two.columns and "kept_x13" in one.columns and "few_k2" in one.columns
    assert not [c for c in one.columns if c.startswith("wide")]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert isinstance(EncodeNarrow().fit(marked.limit(0)), Identity)


def test_unique_keys_are_not_aggregated(spark):
    df = spark.range(20).select("id", (F.col("id") * 2).alias("x"))
    plan, out = Aggregate("id").fit_apply(df)
    assert isinstance(plan, Identity) and out.columns == ["id", "x"]
    twice = df.withColumn("id", F.when(F.col("id") > 18, F.lit(None)).when(F.col("id") == 18, F.lit(None)).otherwise(F.col("id")))
    assert Aggregate("id").fit_apply(twice)[1].where("id is null").first()["len"] == 2


@pytest.mark.parametrize("flavour", ["polars", "pandas"])
def test_date_texts_with_a_time_of_day(spark, flavour):
    texts = ["2024-01-01 10:00:00", "2024/02/03T04:05", "03-02-2024 23:59:59.25", "2024-05-06", None]
    df = spark.createDataFrame([(t, "2024-01-02") for t in texts], "at string, day string")
    plan = fit_narrowing(df, flavour=flavour)
    assert {n.name: n.logical for n in plan.columns} == (
        {"at": "datetime64", "day": "datetime64"} if flavour == "pandas" else {"at": "datetime", "day": "date"}
    )
    m = datetime.datetime
    assert [r["at"] for r in plan.apply(df).collect()] == [
        m(2024, 1, 1, 10), m(2024, 2, 3, 4, 5), m(2024, 2, 3, 23, 59, 59, 250000), m(2024, 5, 6), None
    ]
    for bad in ("2024-01-01 25:00:00", "2024-01-01x", "2024-13-01 10:00:00", "x 2024-01-01"):
        with pytest.raises(ValueError, match="no format parses"):
            fit_narrowing(spark.createDataFrame([(bad,)], "at string"), flavour=flavour)


def test_components_of_many_flags(spark):
    rng = np.random.default_rng(7)
    base = rng.random((120, 5)) > 0.5
    flags = np.concatenate([base, base ^ (rng.random((120, 5)) > 0.9), np.repeat(base[:, :1], 140, 1)], axis=1)
    names = [f"f{i}" for i in range(flags.shape[1])]
    df = spark.createDataFrame([tuple(map(bool, r)) for r in flags], ", ".join(f"{n} boolean" for n in names))
    out = ReduceBooleans().fit(df).apply(df)
    k = round(np.sqrt(len(names)))
    assert out.columns == [f"x_{i}" for i in range(k)]
    got = np.array([tuple(r) for r in out.collect()])
    x = flags.astype(float) - flags.mean(axis=0)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    # The components span what the first right singular vectors span: the same best approximation.
    assert np.allclose(got @ got.T, (x @ vt[:k].T) @ (x @ vt[:k].T).T, atol=1e-6)


def test_a_unique_key_is_settled_without_the_statistics(spark, monkeypatch):
    unique = spark.range(1000).selectExpr("id as k", "id % 7 as v")
    one_null = unique.selectExpr("nullif(k, 5) as k", "v")
    two_null = unique.selectExpr("if(k in (5, 6), null, k) as k", "v")
    last_twice = unique.selectExpr("least(k, 998) as k", "v")
    plan, out = Aggregate("k").fit_apply(two_null)
    assert not isinstance(plan, Identity) and out.count() == 999
    assert Aggregate("k").fit_apply(last_twice)[1].where("k = 998").first()["len"] == 2
    assert Aggregate("k").fit_apply(unique.selectExpr("k % 10 as k", "v"))[1].count() == 10
    assert isinstance(Aggregate("k").fit(unique.limit(0)), Identity)

    def written(*_):
        raise AssertionError("aggregated to find that nothing repeats")

    monkeypatch.setattr(aggregation, "cut", written)
    assert isinstance(Aggregate("k").fit(unique), Identity)
    assert isinstance(Aggregate("k").fit(one_null), Identity)


def test_every_text_column_is_profiled_in_a_batch_of_its_own(spark, monkeypatch):
    df = spark.range(100).selectExpr("id", "'2020-01-02' as a", "concat('x', id) as b", "cast(null as string) as c")
    asked, select = [], type(df).selectExpr
    monkeypatch.setattr(type(df), "selectExpr", lambda self, *e: (asked.append(e), select(self, *e))[1])
    found = profile(df)
    assert max(sum("as s" in e and "n_unparsed" in e.split()[-1] for e in batch) for batch in asked) == 1
    assert [found[c].n_null for c in df.columns] == [0, 0, 0, 100] and found.n_rows == 100
    assert (found["id"].max, found["a"].n_not_date, found["b"].n_not_date) == (99, 0, 100)


def test_iso_dates_parse_as_their_joined_parts(spark):
    values = ["2020-01-05", "2020-01x05", "2020-01-1T", "2020-01-1 ", "2020-13-01", "2020- 1-01", "20x0-01-01",
              "2020/01/05", "05-01-2020", "2020-01-05 10:00", "", "ä020-01-05", None]
    parts = "concat_ws('-', substring(v, 1, 4), substring(v, 6, 2), substring(v, 9, 2))"
    plain = f"case when length(v) = 10 and substring(v, 5, 1) = '-' then try_cast({parts} as date) end"
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.selectExpr("v", f"{parse_date('v', ('yyyy-MM-dd',))} as a", f"{plain} as b").collect()
    assert all(r.a == r.b for r in rows) and sum(r.a is not None for r in rows) == 4


def test_tables_of_a_mart_are_processed_at_once(spark, tmp_path):
    paths = {n: f"{tmp_path}/{n}.parquet" for n in ("base", "person")}
    for i, path in enumerate(paths.values()):
        spark.range(i + 2).write.parquet(path)
    together = Barrier(2)

    def step(df):
        together.wait(60)
        return df.withColumn("seen", F.lit(True))

    targets = process_tables(spark, paths, f"{tmp_path}/out", Chain((step,)))
    assert {n: spark.read.parquet(p).where("seen").count() for n, p in targets.items()} == {"base": 2, "person": 3}


def test_splits_of_a_mart_are_processed_at_once(spark, tmp_path, monkeypatch):
    together = Barrier(2)

    def process(spark, paths, out, *_):
        together.wait(60)
        return {"base": out}

    for split in ("train", "test"):
        spark.range(10).selectExpr("id as case_id", "1 as WEEK_NUM", "1 as target", "id as x").write.parquet(f"{tmp_path}/{split}")
    monkeypatch.setattr(mart, "process_tables", process)
    result = mart.build_mart(spark, str(tmp_path), str(tmp_path))
    assert (result.train.count(), result.test.count(), result.test.columns) == (10, 10, ["case_id", "WEEK_NUM", "target", "x"])
