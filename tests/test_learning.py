"""Early stop, searches with a time limit, the run log, and scores of the caller's own."""

import random
import time

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from martloom.catalog import learn
from martloom.learning import tuning, validation
from martloom.learning.boosting import Watched, best_round, first_rounds, round_scores
from martloom.learning.jobs import log_leaderboard, tune_best, tune_from
from martloom.learning.registry import BOOSTED, WATCHING, EachAgainstTheRest, make, make_for_classes
from martloom.learning.tuning import SPACES, SearchSpace, tune
from martloom.learning.validation import cross_validate, score_column, score_columns, score_functions, temporal_validate
from martloom.operators.metrics import ScoreRanges, auc, group_scalars
from martloom.plans.mart import assemble
from martloom.session import scratch_path
from martloom.sources.runs import RunLog


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(900):
        a, b = rng.random(), rng.random()
        out.append((i, a, b, float(rng.random() < (0.8 if a * b > 0.2 else 0.2)), 2 + a + 3 * b * b, i % 3 == 0))
    df = spark.createDataFrame(out, "key int, a double, b double, y double, amount double, held boolean")
    return assemble(df, ["a", "b"], ("key", "y", "amount", "held")).cache()


def test_best_round_waits_for_the_patience():
    assert best_round([0.5, 0.6, 0.55, 0.61, 0.6, 0.6], 3) == (4, False)
    assert best_round([0.5, 0.6, 0.55, 0.6, 0.6, 0.9], 3) == (2, True)
    assert best_round([None, None, 0.3], 10) == (3, False)
    assert best_round([0.5], 1) == (1, False)


@pytest.mark.parametrize("kind", ["classes", "numbers"])
def test_scores_after_each_round_are_those_of_shorter_models(rows, kind):
    train, seen = rows.where("not held"), rows.where("held")
    if kind == "classes":
        model = GBTClassifier(labelCol="y", maxDepth=2, maxIter=6, seed=42).fit(train)
    else:
        model = GBTRegressor(labelCol="amount", maxDepth=2, maxIter=6, seed=42).fit(train)
    scores = round_scores(model, seen)
    assert len(scores) == model.getNumTrees == 6
    for n in (1, 3, 6):
        part = first_rounds(model, n)
        assert part.getNumTrees == n
        scored = part.transform(seen)
        if kind == "classes":
            value = auc(scored.withColumn("s", score_column(scored)), "y", "s").first()["auc"]
        else:
            value = -scored.select(F.avg(F.abs(F.col("amount") - F.col("prediction")) / F.col("amount"))).first()[0]
        assert scores[n - 1] == pytest.approx(value, abs=1e-9)


def test_a_watched_fit_is_that_of_all_rounds_cut_at_the_best(rows):
    train, seen = rows.where("not held"), rows.where("held")
    estimator = GBTClassifier(labelCol="y", maxDepth=3, seed=42)
    model, scores = Watched(estimator, seen, rounds=40, patience=4, first=3).fit_and_watch(train)
    whole = round_scores(estimator.copy({estimator.maxIter: 40}).fit(train), seen)
    best, stopped = best_round(whole, 4)
    assert (model.getNumTrees, stopped) == (best, True) and scores == pytest.approx(whole[: len(scores)])
    assert len(scores) == best + 4
    # Nothing to watch, or one class only: all rounds stay.
    for none in (seen.limit(0), seen.where("y = 1")):
        assert Watched(estimator, none, rounds=5).fit(train).getNumTrees == 5


def test_watched_model_can_be_stored(rows, spark):
    model = Watched(GBTClassifier(labelCol="y", maxDepth=1), rows.where("held"), rounds=8).fit(rows.where("not held"))
    path = scratch_path(spark, "model")
    model.write().save(path)
    again = type(model).load(path)
    assert again.transform(rows).select("prediction").collect() == model.transform(rows).select("prediction").collect()


def test_families_that_watch(rows):
    for name in WATCHING:
        task = "binary_classification" if name.endswith("Classifier") else "regression"
        made = make(name, task, "y", eval_set=rows)
        assert isinstance(made, Watched) and (made.patience, made.rounds) == (10, BOOSTED[name]["maxIter"])
        assert not isinstance(make(name, task, "y"), Watched)
    assert not isinstance(make("decision_tree", label="y", eval_set=rows), Watched)
    assert make("LGBMClassifier", featureSubsetStrategy=0.5).getFeatureSubsetStrategy() == "0.5"
    assert [len(s.base) for s in SPACES.values()] == [4, 2, 2]
    for name, space in SPACES.items():
        for params in space.trials(6):
            make(name, label="y", eval_set=rows, **params)


def test_classes_one_by_one_watch_too(rows):
    three = rows.withColumn("c", F.when(F.col("amount") > 4, 2.0).when(F.col("amount") > 3, 1.0).otherwise(0.0))
    made = make_for_classes("LGBMClassifier", 3, "c", eval_set=three.where("held"), maxIter=30, maxDepth=2)
    assert isinstance(made, EachAgainstTheRest)
    model = made.fit(three.where("not held"))
    assert len(model.models) == 3 and all(m.getNumTrees < 30 for m in model.models)
    right = model.transform(three.where("held")).select(F.avg((F.col("prediction") == F.col("c")).cast("int"))).first()[0]
    assert right > 0.9


def test_cross_validation_stops_early_in_every_fold(rows, monkeypatch):
    sizes = []
    fit = Watched.fit

    def counted(self, df):
        model = fit(self, df)
        sizes.append(model.getNumTrees)
        return model

    monkeypatch.setattr(Watched, "fit", counted)
    seen = rows.where("held")
    made = make("LGBMClassifier", label="y", eval_set=seen, maxIter=60, maxDepth=2)
    scores = {r.metric: r.score for r in cross_validate(rows.where("not held"), made, "y", "key").collect()}
    assert len(sizes) == 5 and max(sizes) < 60 and scores["roc_auc_score"] > 0.6
    sizes.clear()
    tune(rows.where("not held"), "XGBClassifier", SearchSpace({"a": {"maxIter": 60, "maxDepth": 2}}), "y", "key", 1, eval_set=seen)
    assert len(sizes) == 5 and max(sizes) < 60


def test_time_limit_holds_within_a_batch(rows):
    space = SearchSpace({str(i): {"maxDepth": 1} for i in range(3)})
    with pytest.raises(ValueError, match="no trial"):
        tune(rows, "decision_tree", space, "y", "key", 3, timeout_hours=-1)
    # Each fit takes a second; those of later trials would begin too late.
    real = make("decision_tree", label="y", maxDepth=1)

    class Slow:
        def fit(self, df):
            time.sleep(1)
            return real.fit(df)

    from martloom.learning.validation import out_of_fold, write_folds

    folded = write_folds(rows, "y", "key", "binary_classification", 4)
    scored = out_of_fold(folded, [Slow() for _ in range(6)], "y", 4, time.time() + 2.5)
    trials = {r.trial for r in scored.select("trial").distinct().collect()}
    assert 0 in trials and 5 not in trials
    assert scored.groupBy("trial").count().where(f"count <> {rows.count()}").isEmpty()


def test_tuning_of_a_stored_table(rows, spark):
    path = scratch_path(spark, "stored")
    spark.range(400).selectExpr("id as key", "id % 7 / 7.0 as a", "id % 11 as b", "int(id % 7 > 2) as y").write.parquet(path)
    log = scratch_path(spark, "log")
    found = tune_from(spark, path, "decision_tree", "6:2:2", "key", space=SearchSpace({"one": {"maxDepth": 2}}), run_log=log)
    assert found.best_value == pytest.approx(1.0) and found.trials.count() == 1
    assert RunLog(spark, log).scores("decision_tree").select("gini_score").first()[0] == pytest.approx(1.0)


def test_run_log_keeps_experiments_apart(spark, rows):
    log = RunLog(spark, scratch_path(spark, "runs"))
    log.append("old", spark.createDataFrame([("m", 0.9)], "model string, `metrics.gini_score` double"))
    log.append("All Models", spark.createDataFrame([("early", 0.9)], "model string, `metrics.gini_score` double"))
    models = {"logistic_regression": make("logistic_regression", label="y"), "decision_tree": make("decision_tree", label="y", maxDepth=1)}
    scores = log_leaderboard(log, rows, models, "y", "key")
    assert {r.model for r in scores.collect()} == set(models)
    assert log.scores("All Models").count() == 3 and log.scores("old").count() == 1
    tuned = tune_best(log, scores, rows, {n: SearchSpace({"given": {}}) for n in models}, "y", "key", 1)
    best = max(scores.collect(), key=lambda r: r.gini_score)
    assert list(tuned) == [best.model]
    assert log.scores(best.model).count() == 1


def test_scores_of_the_caller(rows):
    made = make("decision_tree", label="y", maxDepth=1)
    own = score_functions({"brier": lambda y, p: np.mean((y - p) ** 2), "none": lambda y, p: None})
    native = score_columns({"brier": lambda y, p: F.avg((y - p) ** 2)})
    a = {r.metric: r.score for r in cross_validate(rows, made, "y", "key", scorer=own).collect()}
    b = {r.metric: r.score for r in cross_validate(rows, made, "y", "key", scorer=native).collect()}
    assert a["brier"] == pytest.approx(b["brier"]) and a["none"] is None


def test_group_functions(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 2.0)], "g string, x double")
    found = {r.g: (r.width, r.n) for r in group_scalars(df, ("g",), ("x",), {"width": np.ptp, "n": len}).collect()}
    assert found == {"a": (2.0, 2.0), "b": (None, 1.0), None: (0.0, 1.0)}


def test_a_leak_of_the_scored_rows_shows(spark):
    """The order of a feature turns from week to week; a model that saw the scored week would rank it right."""
    rng = random.Random(1)
    out = [(i, i % 4, rng.random()) for i in range(800)]
    df = spark.createDataFrame(out, "key int, week int, x double").selectExpr(
        "key", "week", "int(x > 0.5) as y", "x * pow(3, week) * if(week % 2 = 0, 1, -1) as z"
    )
    steps, _ = temporal_validate(assemble(df, ["z"], ("week", "y")), make("logistic_regression", label="y", regParam=0.1), "y", "week")
    assert all(r.gini == pytest.approx(-1.0) for r in steps.collect())


def test_rows_are_scored_once_for_their_auc(spark):
    """The ranges come from the written points, so what gives the scores runs once, not once more for the ranges."""
    seen = spark.sparkContext.accumulator(0)

    def score(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(200, numPartitions=2).select((F.col("id") % 2).alias("y"), (F.col("id") % 7 / 7).alias("s"))
    scored = rows.mapInArrow(score, "y bigint, s double")
    value = auc(scored, "y", "s").first()["auc"]
    assert seen.value == 200
    assert value == pytest.approx(auc(rows, "y", "s", ranges=ScoreRanges(())).first()["auc"], abs=1e-15)


def test_leaderboard_and_tuning_share_written_folds(spark, monkeypatch):
    written = []

    def counted(*args, **settings):
        written.append(args)
        return validation.write_folds_once(*args, **settings)

    monkeypatch.setattr(validation, "write_folds_once", validation.write_folds, raising=False)
    for place in (validation, tuning, learn):
        monkeypatch.setattr(place, "write_folds", counted, raising=False)
    assert learn.leaderboard_then_tuning(spark, "/root/testdata/sf0.001").count() == 3
    assert len(written) == 1
