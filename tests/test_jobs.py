"""Sources, run log, streaming and learning jobs on small inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from martloom.functions.reports import elapsed_text, parse_metrics, start_time
from martloom.learning.registry import make
from martloom.learning.tuning import SearchSpace, tune
from martloom.learning.validation import cross_validate
from martloom.operators.narrowing import Narrow
from martloom.operators.scaling import Scale
from martloom.plans.mart import assemble
from martloom.session import scratch_path, scratch_root
from martloom.sources.runs import read_metrics
from martloom.sources.tables import Source, is_written, materialise, read_parts, table_paths
from martloom.streaming.apply import write_applied


def test_scratch_follows_the_session_setting(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_catalogue_has_every_table():
    paths = table_paths("/data", "train")
    assert len(paths) == 17
    assert paths["base"] == "/data/train/train_base.parquet"
    assert paths["static_0"] == "/data/train/train_static_0_*.parquet"


def test_materialise_replaces_what_a_lost_job_left(spark, tmp_path):
    path = str(tmp_path / "t")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0.parquet").write_bytes(b"broken")
    assert not is_written(spark, path)
    assert materialise(spark, path, lambda: spark.range(3)).count() == 3
    assert materialise(spark, path, lambda: 1 / 0).count() == 3


def test_parts_with_extra_columns_are_one_scan(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "p_0.parquet"))
    spark.range(3).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "p_1.parquet"))
    df = read_parts(spark, str(tmp_path / "p_*.parquet"))
    assert set(df.columns) == {"id", "x"} and df.where("x is null").count() == 2


def test_empty_later_part_is_left_out_per_file(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "p_0.parquet"))
    spark.range(0).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "p_1.parquet"))
    df = read_parts(spark, str(tmp_path / "p_*.parquet"), lambda d: d, per_file=True)
    assert df.columns == ["id"]


def test_metric_files_of_runs(spark, tmp_path):
    for job, model, text in (
        ("j1", "model_1", "{'auc': 0.5, 'f1': 1}"), ("j1", "model_2", "{'auc': 9}"), ("j2", "model_1", "broken"),
        ("j3", "other", "{'auc': 0.1}"),
    ):
        folder = tmp_path / "77" / job / model
        folder.mkdir(parents=True)
        (folder / "metrics").write_text(text)
    rows = {tuple(r) for r in read_metrics(spark, f"{tmp_path}/77/*/*/metrics").collect()}
    assert rows == {("j1", "auc", 0.5), ("j1", "f1", 1.0)}


def test_run_times(spark):
    rows = [("p-20240102030405678",), ("p-20240102-030405",), ("p-1234",), ("none",)]
    df = spark.createDataFrame(rows, "id string").select("id", start_time(F.col("id")).alias("t"))
    got = {r["id"]: r["t"] for r in df.collect()}
    moment = datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert list(got.values()) == [moment, moment, None, None]
    text = df.where("t is not null").select(elapsed_text(F.to_timestamp(F.lit("2024-01-04 04:03:04")), F.col("t")).alias("e"))
    assert {r["e"] for r in text.collect()} == {"48Hrs 58Min"}


def test_metrics_text(spark):
    df = spark.createDataFrame([("{'a': 1.5}",), ('{"a": 2}',), ("oops",)], "t string")
    got = [r[0] for r in df.select(parse_metrics(F.col("t"))["a"]).collect()]
    assert got == [1.5, 2.0, None]


def test_fitted_plans_run_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "2024-01-01"), (3.0, "2024-01-03")], "v double, day string")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(source)
    narrow = Narrow().fit(df)
    query = write_applied(spark.readStream.schema(df.schema).parquet(source), narrow, out)
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {tuple(r) for r in narrow.apply(df).collect()}
    scaled = Scale().fit(df).apply(spark.readStream.schema(df.schema).parquet(source))
    assert scaled.isStreaming


# -- learning -----------------------------------------------------------------


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).selectExpr(
        "id as key", "cast(id % 20 as double) as x", "cast(id % 7 as double) as u",
        "cast(id % 20 + (id % 3) * 3 > 12 as int) as y",
    )
    return assemble(df, ["x", "u"], ("key", "y")).cache()


def test_cross_validation_scores(rows):
    got = {r["metric"]: r["score"] for r in cross_validate(rows, make("logistic_regression", label="y"), "y", "key", k=3).collect()}
    assert got["roc_auc_score"] > 0.9
    assert got["gini_score"] == pytest.approx(2 * got["roc_auc_score"] - 1)


def test_tuning_tries_base_trials_first_and_logs(rows):
    space = SearchSpace(base={"a": {"maxDepth": 1}, "b": {"maxDepth": 4}}, ranges={"maxDepth": [1, 3]})
    found = tune(rows, "decision_tree", space, "y", "key", n_trials=3, k=2)
    trials = found.trials.orderBy("trial_id").collect()
    assert [t["params"] for t in trials][:2] == ['{"maxDepth": 1}', '{"maxDepth": 4}']
    assert found.best_value == max(t["metrics.gini_score"] for t in trials)


def test_tuning_stops_without_gain(rows):
    space = SearchSpace(ranges={"maxDepth": [2, 2]})
    found = tune(rows, "decision_tree", space, "y", "key", n_trials=12, k=2, patience=3)
    assert found.trials.count() == 4
    with pytest.raises(ValueError):
        tune(rows, "decision_tree", space, "y", "key", n_trials=0, k=2)


def test_search_space_kinds():
    space = SearchSpace(ranges={"c": ["p", "q"], "i": [1, 3], "f": [0.5, 1], "b": [True, False]})
    for t in space.trials(20):
        assert t["c"] in ("p", "q") and t["i"] in (1, 2, 3) and 0.5 <= t["f"] <= 1 and isinstance(t["b"], bool)
    assert list(space.trials(5)) == list(space.trials(5))
    with pytest.raises(TypeError):
        list(SearchSpace(ranges={"m": [None, 1.0]}).trials(1))


def test_source_projects_casts_and_reads_nan_as_null(spark):
    reader = lambda s, n: s.createDataFrame([(1, float("nan"), "a"), (2, 1.5, "b")][:n], "k int, v double, t string")
    source = Source("s", reader, {"n": 2}, columns=("v", "k"), casts={"k": lambda c: c.cast("string")})
    df = source.read(spark)
    assert df.columns == ["v", "k"] and [tuple(r) for r in df.collect()] == [(None, "1"), (1.5, "2")]
