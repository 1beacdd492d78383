"""Operators against brute force, and their edge cases."""

import hashlib
import math
import random
from collections import Counter
from itertools import chain, islice

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from __spark_entry__ import queries
from martloom.catalog.common import MODELS, predictions
from martloom.operators.aggregation import Aggregate
from martloom.operators.combine import merge_features, supertype, union_relaxed
from martloom.learning.registry import make_for_classes
from martloom.operators.correlation import DropCorrelated, correlations
from martloom.operators.encoding import OneHotBoolean, ReduceBooleans, fit_one_hot, label_codes
from martloom.operators import ensemble
from martloom.operators.ensemble import (
    PATIENCE,
    draws,
    edge_rows,
    gini_bounds,
    gini_of_promising,
    gini_of_weights,
    grid,
    packed,
    search_weights,
    wide_predictions,
)
from martloom.operators.filters import align, remove_rows
from martloom.operators.metrics import (
    ScoreRanges,
    attach_scores,
    auc,
    classification_metrics,
    fit_score_ranges,
    gini_by_period,
    stability,
    top_models,
)
from martloom.operators.plan import Identity
from martloom.operators.profile import distinct_values, proves_at_least
from martloom.operators.scaling import Scale
from martloom.operators.splits import folds, group_split, ladder, ratio_split, stratified_folds, stratified_sample
from martloom.plans.chain import Chain
from martloom.plans.mart import numeric_features
from martloom.plans.steps import step1, step2, step3


def place(key, seed):
    return int(hashlib.md5(f"{key}|{seed}".encode()).hexdigest()[:15], 16)


# -- ranking ------------------------------------------------------------------


def naive_auc(rows):
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    return won / (len(pos) * len(neg)) if pos and neg else None


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else "cold", int(rng.random() < 0.4), round(rng.random(), 2)) for i in range(900)]
    rows += [(1000 + i, "hot", i % 2, 0.5) for i in range(400)]  # one score holds a third of all rows
    rows += [(2000 + i, "one_class", 1, 0.1 * i) for i in range(5)]
    return rows, spark.createDataFrame(rows, "id int, grp string, y int, s double").cache()


@pytest.mark.parametrize("bounds", [(), (0.5,), (0.1, 0.2, 0.5, 0.51, 0.9), (-1.0, 5.0)])
def test_auc_does_not_depend_on_the_ranges(scored, bounds):
    rows, df = scored
    got = {r["grp"]: r["auc"] for r in auc(df, "y", "s", ("grp",), ScoreRanges(bounds)).collect()}
    for g in ("hot", "cold"):
        assert got[g] == pytest.approx(naive_auc([(y, s) for _, h, y, s in rows if h == g]))
    assert got["one_class"] is None
    total = auc(df, "y", "s", ranges=ScoreRanges(bounds)).first()["auc"]
    assert total == pytest.approx(naive_auc([(y, s) for *_, y, s in rows]))


@pytest.mark.parametrize("bounds", [(), (0.3,)])
def test_auc_with_a_missing_score_or_target_is_null(spark, bounds):
    rows = [("ok", 1, 0.7), ("ok", 0, 0.2), ("a", 1, None), ("a", 0, 0.1), ("a", 1, 0.2), ("b", None, 0.5), ("b", 1, 0.6),
            ("b", 0, 0.2), ("c", 1, float("nan")), ("c", 0, 0.2), ("c", 1, 0.3)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {r["g"]: r["auc"] for r in auc(df, "y", "s", ("g",), ScoreRanges(bounds)).collect()}
    assert got == {"ok": 1.0, "a": None, "b": None, "c": None}


def test_score_ranges_follow_the_partitions(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("s"))
    assert fit_score_ranges(df, "s", 1) == ScoreRanges(())
    for ranges in (5, None):
        bounds = fit_score_ranges(df, "s", ranges).bounds
        assert len(bounds) == (ranges or 8) - 1 and list(bounds) == sorted(bounds)


def test_gini_by_period_leaves_one_class_periods_null(scored):
    _, df = scored
    got = {r["grp"]: r["gini"] for r in gini_by_period(df, "grp", "y", "s").collect()}
    assert got["one_class"] is None and got["hot"] is not None


def test_stability_against_polyfit(spark):
    values = [0.5, 0.45, 0.47, 0.40, 0.42, 0.30]
    rows = [(10 * i, v) for i, v in enumerate(values)] + [(5, None)]
    df = spark.createDataFrame(rows, "week int, gini double")
    x, y = np.arange(6), np.array(values)
    a, b = np.polyfit(x, y, 1)
    expected = y.mean() + 88.0 * min(0, a) - 0.5 * np.std(y - (a * x + b))
    got = stability(df, "week", "gini", (88.0, -0.5)).first()
    assert got["stability"] == pytest.approx(expected)
    assert stability(df.limit(1), "week", "gini").first()["stability"] is None


def test_macro_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 3)], "y int, p int")
    got = classification_metrics(df, "y", "p").first()
    assert got["accuracy"] == 0.5
    assert got["precision"] == pytest.approx((1 + 0.5 + 0 + 0) / 4)
    assert got["recall"] == pytest.approx((0.5 + 1 + 0 + 0) / 4)
    assert got["f1"] == pytest.approx((2 / 3 + 2 / 3 + 0 + 0) / 4)


def test_top_models_ties_by_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0), ("d", None)], "model string, gini double")
    assert [r["model"] for r in top_models(df, "gini", 2).collect()] == ["c", "a"]


# -- ensembles ----------------------------------------------------------------


def test_gini_of_weights_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i % 2, round(rng.random(), 1), round(rng.random(), 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    got = {r["trial"]: r["gini"] for r in gini_of_weights(df, "y", ["a", "b"], grid(2)).collect()}
    for i, (u, v) in enumerate(grid(2)):
        assert got[i] == pytest.approx(2 * naive_auc([(y, (u * a + v * b) / 2) for y, a, b in rows]) - 1), (u, v)


def test_search_stops_without_gain_and_regression_minimises(spark):
    df = spark.createDataFrame([(float(i), i * 2.0, 1.0) for i in range(1, 40)], "t double, a double, b double")
    found = search_weights(df, "t", ["a", "b"], "regression", patience=30, batch=20)
    assert found.score < 0.35 and found.n_trials >= 31
    again = search_weights(df, "t", ["a", "b"], "regression", patience=30, batch=20)
    assert again == found


def searched(y, m, patience):
    """Grid and draws one after another: best weights, Gini, its place, trials."""
    source, best, at, done = chain(grid(m.shape[1]), draws(m.shape[1])), -2.0, 0, 0
    while done - at <= patience:
        w = next(source)
        score = sum(x * m[:, j] for j, x in enumerate(w)) / len(w)
        one, none = score[y == 1], np.sort(score[y != 1])
        below = np.searchsorted(none, one, "left") + np.searchsorted(none, one, "right")
        gini = below.sum() / (len(one) * len(none)) - 1
        if gini > best + 1e-12:
            best, at, weights = gini, done, w
        done += 1
    return weights, best, at, done


def test_bounds_hold_every_gini(spark):
    """Also with ties, scores without a bound, and rows without a target."""
    rng = random.Random(8)
    rows = [(rng.randint(0, 1), rng.choice([0.1, 0.5, rng.random()]), rng.gauss(0, 1) ** 3) for _ in range(6000)]
    df = spark.createDataFrame(rows, "y int, a double, b double").repartition(5).cache()
    trials = [*grid(2), *islice(draws(2), 20)]
    exact = {r["trial"]: r["gini"] for r in gini_of_weights(df, "y", ["a", "b"], trials).collect()}
    bounds = {r.trial: (r.low, r.high) for r in gini_bounds(df, "y", ["a", "b"], trials, edge_rows(df, ["a", "b"])).collect()}
    assert len(bounds) == len(trials)
    for i, gini in exact.items():
        assert bounds[i][0] - 1e-9 <= gini <= bounds[i][1] + 1e-9
    # A trial with a few tied scores only is bounded by their bins; draws spread and are bounded closely.
    assert all(bounds[i][1] - bounds[i][0] < 0.2 for i in range(len(grid(2)), len(trials)))
    assert all(
        r.low is None for r in gini_bounds(df.selectExpr("case when a > 0.9 then null else y end as y", "a", "b"), "y",
                                           ["a", "b"], trials, edge_rows(df, ["a", "b"])).collect()
    )
    found = gini_of_promising(df, "y", ["a", "b"], trials, edge_rows(df, ["a", "b"]), None)
    ranked = {r.trial: r.gini for r in found.collect()}
    assert len(ranked) < len(trials)
    reached = -1.0
    for i in range(len(trials)):
        if exact[i] > reached + 1e-9:
            assert ranked[i] == pytest.approx(exact[i])
        reached = max(reached, exact[i])


def test_search_finds_a_draw_better_than_the_grid(spark):
    rng = random.Random(5)
    rows = [(rng.random(), rng.random()) for _ in range(300)]
    rows = [(int(0.3 * a + 0.8 * b > 0.5), a, b) for a, b in rows]
    weights, best, at, done = searched(np.array([r[0] for r in rows]), np.array([r[1:] for r in rows]), 100)
    found = search_weights(spark.createDataFrame(rows, "y int, a double, b double"), "y", ["a", "b"], patience=100)
    assert at >= len(grid(2)) and (found.weights, found.n_trials) == (weights, done)
    assert found.score == pytest.approx(best)


def test_close_trials_are_bounded_again_before_they_are_ranked(spark, monkeypatch):
    """Scores that say nothing of the target: all trials lie within the first bounds, and few are ranked."""
    rng = random.Random(11)
    rows = [(rng.randint(0, 1), *(rng.random() for _ in range(3))) for _ in range(40_000)]
    df = spark.createDataFrame(rows, "y int, a double, b double, c double").cache()
    weights, best, at, done = searched(np.array([r[0] for r in rows]), np.array([r[1:] for r in rows]), 60)
    ranked = []
    monkeypatch.setattr(ensemble, "gini_of_weights", lambda *a: ranked.extend(a[3]) or gini_of_weights(*a))
    found = search_weights(df, "y", ["a", "b", "c"], patience=60)
    assert (found.weights, found.n_trials) == (weights, done) and found.score == pytest.approx(best)
    assert len(ranked) <= 16


def test_search_reads_its_rows_a_few_times_only(spark):
    """However many batches of trials and rounds of bounds there are."""
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.random(), rng.random()) for _ in range(3000)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "y int, a double, b double")
    weights, best, _, done = searched(np.array([r[0] for r in rows]), np.array([r[1:] for r in rows]), 600)
    found = search_weights(df.mapInArrow(counted, df.schema), "y", ["a", "b"], patience=600)
    assert (found.weights, found.n_trials) == (weights, done) and found.score == pytest.approx(best)
    assert read.value <= 3 * len(rows)


def test_packed_rows_rank_as_others_do(spark):
    """Over many ranges and blocks; values without a bound leave trials that weigh them by zero without a score."""
    rng = random.Random(6)
    rows = [(rng.randint(0, 1), rng.choice([0.0, -0.0, 0.5, rng.random()]), rng.gauss(0, 1)) for _ in range(1200)]
    trials = [*grid(2), *islice(draws(2), 5)]
    df = spark.createDataFrame(rows, "y int, a double, b double").repartition(3).cache()
    held = packed(df, "y", ["a", "b"])
    assert held.blocks.count() > 3 and held.blocks.selectExpr("sum(neg + pos + bad)").first()[0] == len(rows)
    sample = edge_rows(df, ["a", "b"])
    exact = {i: 2 * naive_auc([(y, (u * a + v * b) / 2) for y, a, b in rows]) - 1 for i, (u, v) in enumerate(trials)}
    for table in (df, held):
        got = {r.trial: r.gini for r in gini_of_weights(table, "y", ["a", "b"], trials, sample).collect()}
        assert got == pytest.approx(exact)
    endless = df.unionByName(spark.createDataFrame([(1, float("inf"), 0.0), (0, float("-inf"), 1.0)], df.schema))
    got = {r.trial: r.gini for r in gini_of_weights(endless, "y", ["a", "b"], trials).collect()}
    assert {i for i, g in got.items() if g is None} == {i for i, w in enumerate(trials) if not w[0]}
    bounds = {r.trial: (r.low, r.high) for r in gini_bounds(endless, "y", ["a", "b"], trials, sample).collect()}
    for i, g in got.items():
        assert bounds[i] == (None, None) if g is None else bounds[i][0] - 1e-9 <= g <= bounds[i][1] + 1e-9
    one_class = packed(df.where("y = 1"), "y", ["a", "b"])
    assert all(r.gini is None for r in gini_of_weights(one_class, "y", ["a", "b"], trials, sample).collect())


def test_registered_search_goes_on_after_the_grid(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in predictions(spark, sf).select("y", *MODELS).collect()]
    weights, best, _, done = searched(np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], dtype=float), PATIENCE)
    got = queries()["ensemble_search_full"](spark, sf).first()
    assert (got.gini, got.n_trials, tuple(got.weights)) == (pytest.approx(best, abs=1e-6), done, weights)
    assert done > 1000


# -- splits -------------------------------------------------------------------


def test_ratio_split_sizes_and_order(spark):
    df = spark.range(1003).withColumn("label", F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "b"))
    got = {r["id"]: r["split"] for r in ratio_split(df, "6:2:2", "id").collect()}
    held = math.ceil(1003 * 4 / 10)
    tested = math.ceil(held / 2)
    assert Counter(got.values()) == {"train": 1003 - held, "valid": held - tested, "test": tested}
    order = sorted(range(1003), key=lambda k: (place(k, 42), k))
    assert [got[k] for k in order] == sorted(got.values(), key=["train", "valid", "test"].index)


def test_stratified_split_keeps_null_label_as_its_own(spark):
    df = spark.range(1000).withColumn("label", F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "b"))
    rows = ratio_split(df, "5:3:2", "id", stratify="label").groupBy("label", "split").count().collect()
    got = {(r["label"], r["split"]): r["count"] for r in rows}
    assert got == {
        ("hot", "train"): 350, ("hot", "valid"): 210, ("hot", "test"): 140,
        ("b", "train"): 100, ("b", "valid"): 60, ("b", "test"): 40,
        (None, "train"): 50, (None, "valid"): 30, (None, "test"): 20,
    }


def test_group_split_keeps_groups_whole_with_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id") % 101).alias("g"), "id")
    out = group_split(df, "g")
    assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    sizes = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count_distinct("g").alias("n")).collect()}
    assert sizes == {"train": 60, "valid": 20, "test": 21}
    assert out.count() == 3000


def test_folds_and_samples(spark):
    df = spark.range(503).withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    sizes = [r["count"] for r in folds(df, 5, "id").groupBy("fold").count().collect()]
    assert sorted(sizes) == [100, 100, 101, 101, 101]
    per = stratified_folds(df, "label", 5, "id").groupBy("label", "fold").count().collect()
    for label, n in ((0, 335), (1, 168)):
        counts = [r["count"] for r in per if r["label"] == label]
        assert len(counts) == 5 and sum(counts) == n and max(counts) - min(counts) <= 1
    drawn = stratified_sample(df, "label", 0.25, "id")
    assert {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()} == {0: 83, 1: 42}
    assert stratified_sample(df, "label", 1.0, "id").count() == 503
    assert stratified_sample(df, "label", 0.0, "id").count() == 0
    rare = df.withColumn("label", F.when(F.col("id") == 9, "rare").otherwise("common"))
    assert stratified_sample(rare, "label", 0.5, "id").where("label = 'rare'").count() == 0


def test_splits_do_not_depend_on_partitions_or_row_order(spark):
    df = spark.range(500)
    a = {tuple(r) for r in ratio_split(df, "6:2:2", "id").collect()}
    b = {tuple(r) for r in ratio_split(df.repartition(7).orderBy(F.desc("id")), "6:2:2", "id").collect()}
    assert a == b


def test_many_strata(spark):
    df = spark.range(2000).withColumn("label", F.col("id") % 50)
    drawn = stratified_sample(df, "label", 0.5, "id")
    assert {r["count"] for r in drawn.groupBy("label").count().collect()} == {20}


def test_ladder():
    assert ladder(1000, 10).small == 1000
    sizes = ladder(10_000_000, 100)
    assert (sizes.small, sizes.medium, sizes.full) == (78125, math.isqrt(10_000_000 * 78125), 10_000_000)


# -- distinct values and encodings --------------------------------------------


def test_distinct_values_bound(spark):
    df = spark.range(5000).selectExpr("cast(id % 3 as string) as few", "cast(id as string) as many", "cast(null as string) as none")
    got = distinct_values(df, ["few", "many", "none"], 11)
    assert got["few"].values == ["0", "1", "2"] and got["many"].values is None
    assert got["none"].values == [] and got["none"].n_null == 5000
    exact = distinct_values(df, ["few", "many"], 5000)
    assert exact["many"].values is None
    assert len(distinct_values(df, ["many"], 5001)["many"].values) == 5000


def test_sketch_proof_never_overstates():
    # n - 1 values set at most n - 1 registers of 512.
    for n in (2, 11, 100, 256):
        at_most = 512 * math.log(512 / (512 - (n - 1)))
        assert not proves_at_least(round(at_most), n)
    assert proves_at_least(60, 11)


def test_one_hot_limit_is_an_error(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="more than 20"):
        fit_one_hot(df, ["c"], limit=20)


def test_one_hot_null_column_comes_last_and_unseen_values_are_all_zero(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "c string")
    plan = fit_one_hot(df, ["c"])
    assert plan.apply(df).columns == ["c_a", "c_b", "c_null"]
    other = spark.createDataFrame([("z",)], "c string")
    assert tuple(plan.apply(other).first()) == (0, 0, 0)


def test_label_codes_over_several_ranges(spark):
    df = spark.range(2000).select(F.concat(F.lit("v"), F.col("id") % 700).alias("c"))
    codes = {r["value"]: r["code"] for r in label_codes(df.repartition(5), "c").collect()}
    assert codes == {v: i for i, v in enumerate(sorted(f"v{k}" for k in range(700)))}


def test_reduced_booleans_reconstruct(spark):
    rng = random.Random(1)
    rows = [(*[rng.random() < p for p in (0.2, 0.5, 0.8, 0.5)], i) for i in range(300)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, d boolean, id int")
    out = ReduceBooleans().fit(df).apply(df)
    assert out.columns == ["id", "x_0", "x_1"]
    x = np.array([r[:4] for r in rows], dtype=float)
    x -= x.mean(axis=0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    vt = np.array([v * np.sign(v[np.abs(v).argmax()]) for v in vt])
    got = np.array([(r["x_0"], r["x_1"]) for r in out.orderBy("id").collect()])
    assert np.allclose(got, x @ vt[:2].T, atol=1e-8)


def test_boolean_one_hot_names(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "c string, n int")
    assert OneHotBoolean().fit(df).apply(df).dtypes == [("n", "int"), ("c_a", "boolean"), ("c_nan", "boolean")]


# -- correlation --------------------------------------------------------------


def test_partners_far_from_the_mean_of_their_column(spark):
    rng = np.random.default_rng(1)
    far = rng.normal(1e7, 1, 100)
    rows = [(0.0, None) for _ in range(20_000)] + [(float(v), float(3 * v + rng.normal())) for v in far]
    two = spark.createDataFrame(rows, "x double, y double").repartition(4)
    five = two.withColumns({c: F.rand(3) for c in ("a", "b", "c")})
    expected = np.corrcoef([r[0] for r in rows[-100:]], [r[1] for r in rows[-100:]])[0, 1]
    for df in (two, five):
        got = {(r["col1"], r["col2"]): r["corr"] for r in correlations(df).collect()}
        assert got["x", "y"] == pytest.approx(expected, rel=1e-6)


def test_an_infinite_value_drops_no_column_and_stops_no_scaling(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (float("inf"), 3.0)], "x double, y double")
    assert DropCorrelated(threshold=0.5, absolute=True).fit(df).apply(df).columns == ["x", "y"]
    assert Scale().fit(df).apply(df).count() == 3


def test_one_hot_names_that_clash_are_an_error(spark):
    df = spark.createDataFrame([("null", 1), (None, 2)], "f string, n int")
    with pytest.raises(ValueError, match="clash"):
        fit_one_hot(df, ["f"])
    df = spark.createDataFrame([("a", 1)], "f string, f_a int")
    with pytest.raises(ValueError, match="clash"):
        fit_one_hot(df, ["f"])


def test_one_hot_beyond_five_thousand_values(spark):
    df = spark.range(6000).select(F.format_string("v%04d", "id").alias("c"))
    assert len(fit_one_hot(df, ["c"]).values[0][1]) == 6000


def test_components_of_equal_flags_and_missing_ones(spark):
    rows = [(True, False), (False, True), (True, False), (None, True)] * 5
    df = spark.createDataFrame(rows, "a boolean, b boolean")
    plans = {ReduceBooleans().fit(df.repartition(n)).loadings[0][0] > 0 for n in (1, 2, 3, 5)}
    assert plans == {True}
    assert ReduceBooleans().fit(df).apply(df).where("x_0 is null").count() == 0


def test_rows_without_a_score_stay(spark):
    base = spark.createDataFrame([(1, 0), (2, 1)], "k int, y int")
    scores = spark.createDataFrame([(1, 0.5)], "k int, s double")
    assert attach_scores(base, scores, "k").count() == 2
    wide = wide_predictions({"a": scores.withColumnRenamed("s", "score"), "b": base.selectExpr("k", "y / 2.0 as score")}, "k")
    assert wide.where("a is null").count() == 1 and wide.count() == 2


def test_flags_are_features_and_texts_are_an_error(spark):
    df = spark.createDataFrame([(1, True, "x"), (2, None, "y")], "n int, flag boolean, t string")
    out, names = numeric_features(df, ["n", "flag"])
    assert names == ["n", "flag"] and [r["flag"] for r in out.orderBy("n").collect()] == [1.0, None]
    with pytest.raises(ValueError, match="neither"):
        numeric_features(df, ["n", "t"])


def test_a_family_is_kept_for_three_classes(spark):
    rows = [(float(i), float(i % 3)) for i in range(60)]
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "x double, label double"))
    for name, kind in (("logistic_regression", "LogisticRegressionModel"), ("LGBMClassifier", "OneVsRestModel")):
        assert type(make_for_classes(name, 3, maxIter=2).fit(df)).__name__ == kind


def test_correlations_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    x[:, 1] += x[:, 0] * 2
    x[:, 3] = 1e6 + x[:, 3]
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r) + (3.25,) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, flat double").repartition(5)
    got = {(r["col1"], r["col2"]): r["corr"] for r in correlations(df).collect()}
    assert len(got) == 10
    names = "abcd"
    for i in range(4):
        assert got[(names[i], "flat")] is None
        for j in range(i + 1, 4):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            assert got[(names[i], names[j])] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-8)


# -- combining ----------------------------------------------------------------


def test_supertypes():
    assert supertype(T.ShortType(), T.LongType()) == T.LongType()
    assert supertype(T.LongType(), T.FloatType()) == T.DoubleType()
    assert supertype(T.IntegerType(), T.StringType()) == T.StringType()
    assert supertype(T.NullType(), T.DateType()) == T.DateType()


def test_union_relaxed(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([("q", 1.5)], "x string, z double")
    out = union_relaxed([a, b])
    assert out.dtypes == [("x", "string"), ("y", "int"), ("z", "double")]
    assert {tuple(r) for r in out.collect()} == {("1", 2, None), ("q", None, 1.5)}


def test_merge_suffix_counts_empty_tables_and_clash_raises(spark):
    base = spark.createDataFrame([(1, 5)], "case_id int, v int")
    t = spark.createDataFrame([(1, 6)], "case_id int, v int")
    out = merge_features(base, [t.limit(0), t], "case_id", [True, False])
    assert out.columns == ["case_id", "v", "v_1"] and tuple(out.first()) == (1, 5, 6)
    with pytest.raises(ValueError, match="v_0"):
        merge_features(base.withColumn("v_0", F.lit(1)), [t], "case_id")


def test_align(spark):
    df = spark.createDataFrame([(1, 2)], "a int, extra int")
    out = align(df, ["kind_null", "b", "a"])
    assert out.columns == ["kind_null", "b", "a"] and tuple(out.first()) == (1.0, None, 1)


def test_remove_rows_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None), (5, 1), (None, 9)], "a int, b int")
    assert [tuple(r) for r in remove_rows(df, ["a", "b"], lambda c: c > 4).collect()] == [(1, None)]


# -- aggregation, scaling, chains ----------------------------------------------


def test_aggregate_null_key_is_a_group_and_unique_keys_pass(spark):
    df = spark.createDataFrame([(None, 1.0, "a"), (None, 3.0, "b"), (1, 5.0, "c")], "k int, v double, t string")
    out = Aggregate("k").plan(df).apply(df)
    got = {r["k"]: (r["len"], r["mean_v"], r["std_v"]) for r in out.collect()}
    assert got == {None: (2, 2.0, pytest.approx(math.sqrt(2))), 1: (1, 5.0, None)}
    assert isinstance(Aggregate("k").fit(df.where("k = 1")), Identity)


def test_scale_constant_and_null(spark):
    df = spark.createDataFrame([(1.0, 4.0, None), (3.0, 4.0, None)], "a double, flat double, none double")
    out = Scale().fit(df).apply(df)
    assert {tuple(r) for r in out.collect()} == {(-1.0, 0.0, None), (1.0, 0.0, None)}
    # Columns that are gone are passed over.
    assert Scale().fit(df).apply(df.drop("flat")).columns == ["a", "none"]


def children(spark, ids):
    rows = [(i, g, float((i * 7 + g) % 5), "xyz"[(i + g) % 3], f"2024-01-{1 + (i + g) % 28:02d}") for i in ids for g in range(4)]
    return spark.createDataFrame(rows, "case_id int, num_group1 int, v double, kind string, day string")


def test_rows_of_a_key_do_not_depend_on_other_keys(spark):
    few = step1()(children(spark, range(7)))
    all_ = step1()(children(spark, range(60)))
    shared = [c for c in few.columns if c in all_.columns]
    rows = lambda df: {tuple(float(x) if x is not None else None for x in r) for r in df.select(*shared).where("case_id < 7").collect()}
    assert len(shared) == len(few.columns) and rows(few) == rows(all_)


def test_fitted_chain_applies_to_other_rows(spark):
    plan, _ = step1().fit_apply(children(spark, range(30)))
    out = plan.apply(children(spark, range(30, 33)))
    assert out.count() == 3 and "mean_kind_x" in out.columns


def test_chain_skips_a_table_without_rows(spark):
    df = children(spark, range(3)).limit(0)
    for chain in (step1(), step2(), step3(), Chain((lambda d: d.drop("v"),))):
        assert chain(df).schema == df.schema
