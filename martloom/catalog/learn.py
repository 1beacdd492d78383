"""Training, validation, tuning, selection and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from martloom.catalog.common import query, r6, sql_auc, sql_metrics, sql_order, sql_r6, table
from martloom.learning.jobs import (
    batch_score,
    log_leaderboard,
    predictions,
    select_model,
    train_and_evaluate,
    train_from,
    tune_best,
    tune_from,
)
from martloom.learning.registry import make
from martloom.learning.tuning import SearchSpace, tune
from martloom.learning.validation import N_FOLDS, cross_validate, leaderboard, score_functions, temporal_validate, write_folds
from martloom.operators.metrics import METRICS, OVER_SCORES, group_scalars
from martloom.operators.scaling import Scale
from martloom.operators.splits import ratio_split
from martloom.plans.mart import assemble
from martloom.session import cut, scratch_path
from martloom.sources.runs import RunLog, append_runs, read_runs
from martloom.sources.tables import snapshot


def _events(spark, sf):
    """Events with a noisy label that grows with the value."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("key"),
        F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("week"),
        (F.col("value") / 100).alias("x"),
        (F.col("user_id") % 10).cast("double").alias("u"),
        (k / 100).alias("k"),
        (F.col("value") + k > 100).cast("int").alias("y"),
        (k / 50 + F.col("value") / 200).alias("amount"),
    )


SQL_EVENTS = """
select event_id as key, floor((day(ts) - 1) / 7)::int as week, value / 100 as x, (user_id % 10)::double as u,
  (props::json->>'$.k')::double / 100 as k, (value + (props::json->>'$.k')::double > 100)::int as y,
  (props::json->>'$.k')::double / 50 + value / 200 as amount
from events
"""
FEATURES = ["x", "u", "k"]


def _vectors(spark, sf, features=("x",)):
    return assemble(_events(spark, sf), list(features), ("key", "week", "y", "amount"))


def _sql_folds(strata: str = "") -> str:
    part = f"partition by {strata} " if strata else ""
    fold = " + ".join(f"(rn > floor(n * {i} / 5))::int" for i in range(1, 5))
    return f"""select *, {fold} as fold from (
      select *, row_number() over ({part}order by {sql_order("key", 42)}) as rn,
             count(*) over ({part.strip()}) as n from ({SQL_EVENTS}))"""


# With one feature that raises the odds, a logistic model ranks rows as the feature does.
@query(f"""
select unnest(['roc_auc_score', 'gini_score']) as metric,
       unnest([{sql_r6("avg(auc)")}, {sql_r6("avg(2 * auc - 1)")}]) as score
from ({sql_auc(_sql_folds("y"), ("fold",), score="x", target="y")})
""")
def cv_classifier(spark, sf):
    model = make("logistic_regression", label="y", regParam=0.01)
    out = cross_validate(_vectors(spark, sf), model, "y", "key")
    return out.select("metric", r6("score").alias("score"))


_SQL_CV_ERRORS = f"""
with f as ({_sql_folds()}),
  line as (select i as fold, regr_slope(amount, x) as a, regr_intercept(amount, x) as b
           from f, range(5) t(i) where fold <> i group by i),
  e as (select fold, amount as y, a * x + b as p, avg(amount) over (partition by fold) as m from f join line using (fold)),
  s as (select fold, -avg((y - p) ** 2) as neg_mean_squared_error, -sqrt(avg((y - p) ** 2)) as neg_root_mean_squared_error,
          -avg(abs(y - p)) as neg_mean_absolute_error, 1 - sum((y - p) ** 2) / sum((y - m) ** 2) as r2,
          -avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) as neg_mean_absolute_percentage_error
        from e group by fold)
select metric, {sql_r6("avg(score)")} as score
from (unpivot s on columns(* exclude fold) into name metric value score) group by metric
"""


@query(_SQL_CV_ERRORS)
def cv_regressor(spark, sf):
    out = cross_validate(_vectors(spark, sf), make("linear", "regression", "amount"), "amount", "key", "regression")
    return out.select("metric", r6("score").alias("score"))


# The feature `z` ranks rows one way in even weeks and the other way in odd ones, more widely
# each week, so the sign a model gives it tells which weeks it was trained on: the sign of the
# covariance of feature and label over those weeks.
def _turning(spark, sf):
    turn = F.when(F.col("week") % 2 == 0, 1).otherwise(-1) * F.pow(F.lit(3.0), "week")
    rows = _events(spark, sf).select("key", "week", "y", (turn * F.col("x")).alias("z"))
    return assemble(rows, ["z"], ("key", "week", "y"))


_SQL_TURNING = f"""
  select *, x * pow(3.0::double, week) * case when week % 2 = 0 then 1 else -1 end as z from ({SQL_EVENTS})
"""
_SQL_TURNED = f"""
  with t as ({_SQL_TURNING}),
    side as (select w.week as upto, sign(covar_pop(z, y)) as s
             from (select distinct week from t where week >= 1) w join t on t.week < w.week group by w.week),
    g as (select week, 2 * auc - 1 as own from ({sql_auc(_SQL_TURNING, ("week",), score="z", target="y")}))
  select week, s * own as gini from g join side on upto = week
"""


@query(f"select week as period, {sql_r6('gini')} as gini from ({_SQL_TURNED})")
def temporal_cv(spark, sf):
    model = make("logistic_regression", label="y", regParam=1e-6)
    steps, _ = temporal_validate(_turning(spark, sf), model, "y", "week")
    return steps.select("period", r6("gini").alias("gini"))


@query(f"""
with g as (select week, gini, (week - 1)::double as x from ({_SQL_TURNED})),
  line as (select regr_slope(gini, x) as a, regr_intercept(gini, x) as b, avg(gini) as mean from g),
  d as (select sqrt(avg((gini - a * x - b) ** 2)) as spread from g, line)
select {sql_r6(f"mean + {OVER_SCORES[0]}::double * least(0.0::double, a) + {OVER_SCORES[1]}::double * spread")} as stability
from line, d
""")
def temporal_stability(spark, sf):
    model = make("logistic_regression", label="y", regParam=1e-6)
    _, steady = temporal_validate(_turning(spark, sf), model, "y", "week", OVER_SCORES)
    return steady.select(r6("stability").alias("stability"))


# Settings of the registered queries: MLlib takes about a second a tree on a small machine,
# whatever the size of the table. The library's own defaults are 100 to 1000 rounds.
QUICK = {"maxIter": 16, "maxDepth": 3}


@query()
def train_evaluate(spark, sf):
    path = snapshot(_events(spark, sf).select("key", *FEATURES, "y"), scratch_path(spark, "train"), "events")
    return train_from(spark, path, "LGBMClassifier", "6:2:2", "key", **QUICK).metrics


# A tree of depth one on a 0/1 feature predicts the majority label of the training rows
# with the same feature value, and so does the baseline.
def _steps(spark, sf):
    return _events(spark, sf).select("key", (F.col("x") > 0.6).cast("double").alias("f"), "y")


SQL_STEPS = f"select key, (x > 0.6)::int as f, y from ({SQL_EVENTS})"
SQL_STEP_SETS = f"""
with ranked as (select *, row_number() over (order by {sql_order("key", 42)}) as rn, count(*) over () as n
                from ({SQL_STEPS})),
  placed as (select *, case when rn <= n - ceil(n * 4 / 10) then 'train'
               when rn <= n - ceil(ceil(n * 4 / 10) * 2 / 4) then 'valid' else 'test' end as split from ranked),
  leaf as (select f, avg(y) as p from placed where split = 'train' group by f)
"""
SQL_STEP_METRICS = sql_metrics(f"""
{SQL_STEP_SETS}
select unnest(case split when 'train' then ['train'] else ['test', 'baseline'] end) as set, y, (p > 0.5)::int as p
from placed join leaf using (f) where split <> 'valid'
""")


@query(
    " union all ".join(
        f"select set || '_{m}' as metric, {sql_r6(m)} as value from ({SQL_STEP_METRICS})" for m in METRICS
    )
)
def train_evaluate_step(spark, sf):
    out = train_and_evaluate(_steps(spark, sf), "decision_tree", "6:2:2", "key", maxDepth=1)
    return out.metrics.select("metric", r6("value").alias("value"))


@query(f"{SQL_STEP_SETS} select key, round(p, 4) as decision_tree, round(p, 4) as logistic_regression from placed join leaf using (f)")
def predictions_step(spark, sf):
    """Both families give the share of positives among the rows with the same feature."""
    rows = assemble(ratio_split(_steps(spark, sf), "6:2:2", "key"), ["f"], ("key", "y", "split"))
    settings = {"decision_tree": {"maxDepth": 1}, "logistic_regression": {"tol": 1e-8}}
    train = rows.where("split = 'train'")
    models = {n: make(n, label="y", **s).fit(train) for n, s in settings.items()}
    out = predictions(models, rows, "key")
    return out.select("key", *[F.round(n, 4).alias(n) for n in models])


@query()
def train_multiclass(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("key"), (F.col("value") / 100).alias("x"), (F.col("user_id") % 10).alias("u"),
        F.when(F.col("value") > 60, 2).when(F.col("value") > 20, 1).otherwise(0).alias("y"),
    )
    return train_and_evaluate(rows, "LGBMClassifier", "6:2:2", "key", **QUICK).metrics


@query()
def leaderboard_models(spark, sf):
    families = ("logistic_regression", "decision_tree", "naive_bayes", "linear_svm")
    models = {n: make(n, label="y", **({"maxIter": 10} if n == "linear_svm" else {})) for n in families}
    return leaderboard(_vectors(spark, sf, FEATURES), models, "y", "key")


SQL_FOLD_RANKS = sql_auc(_sql_folds("y"), ("fold",), score="x", target="y")


@query(f"""
select unnest(['logistic_regression', 'linear_svm']) as model, {sql_r6("avg(auc)")} as roc_auc_score,
       {sql_r6("avg(2 * auc - 1)")} as gini_score
from ({SQL_FOLD_RANKS})
""")
def leaderboard_one_feature(spark, sf):
    settings = {"logistic_regression": {"regParam": 0.01}, "linear_svm": {"regParam": 0.01, "maxIter": 10}}
    models = {n: make(n, label="y", **s) for n, s in settings.items()}
    out = leaderboard(_vectors(spark, sf), models, "y", "key")
    return out.select("model", *[r6(c).alias(c) for c in ("roc_auc_score", "gini_score")])


@query()
def leaderboard_regressors(spark, sf):
    models = {n: make(n, "regression", "amount") for n in ("linear", "ridge", "lasso", "elastic_net", "decision_tree")}
    return leaderboard(_vectors(spark, sf, FEATURES), models, "amount", "key", "regression")


@query()
def tune_trials(spark, sf):
    """The tuning job by the place of its table: start trials, watched fits, a log of trials."""
    path = snapshot(_events(spark, sf).select("key", *FEATURES, "y"), scratch_path(spark, "train"), "events")
    log = scratch_path(spark, "tuning-log")
    space = SearchSpace({"default": {"maxIter": 4, "maxDepth": 2}}, {"maxIter": [3, 5], "maxDepth": [1, 2], "stepSize": [0.05, 0.3]})
    tune_from(spark, path, "XGBClassifier", "6:2:2", "key", n_trials=2, space=space, run_log=log)
    return read_runs(spark, log)


_STEP_FOLD = " + ".join(f"(rn > floor(n * {i} / 5))::int" for i in range(1, 5))
SQL_STEP_FOLDS = f"""
select *, {_STEP_FOLD} as fold from (
  select *, row_number() over (partition by y order by {sql_order("key", 42)}) as rn,
         count(*) over (partition by y) as n from ({SQL_STEPS}))
"""


@query(f"""
select unnest([0, 1, 2])::int as trial_id, 'decision_tree' as model,
       unnest(['{{"maxDepth": 1}}', '{{"maxDepth": 3}}', '{{"maxDepth": 2}}']) as params,
       {sql_r6("avg(2 * auc - 1)")} as gini
from ({sql_auc(SQL_STEP_FOLDS, ("fold",), score="f", target="y")})
""")
def tune_step(spark, sf):
    """Trees of any depth rank a 0/1 feature alike; the trials keep their order."""
    rows = assemble(_steps(spark, sf), ["f"], ("key", "y"))
    space = SearchSpace({"a": {"maxDepth": 1}, "b": {"maxDepth": 3}}, {"maxDepth": [2, 2]})
    trials = tune(rows, "decision_tree", space, "y", "key", n_trials=3).trials
    return trials.select("trial_id", "model", "params", r6("`metrics.gini_score`").alias("gini"))


# What a depth-one tree on the 0/1 feature predicts for a fold comes from the other folds alone.
_SQL_BRIER = f"""
  with f as ({SQL_STEP_FOLDS}),
    leaf as (select i as fold, f, avg(y) as p from f, range(5) t(i) where fold <> i group by i, f)
  select 'brier' as metric, avg(score) as score
  from (select fold, avg((y - p) ** 2) as score from f join leaf using (fold, f) group by fold)
"""


@query(f"select metric, {sql_r6('score')} as score from ({_SQL_BRIER})")
def cv_user_score(spark, sf):
    """A score of the caller's own, as a Python function of labels and scores."""
    rows = assemble(_steps(spark, sf), ["f"], ("key", "y"))
    brier = score_functions({"brier": lambda y, p: np.mean((y - p) ** 2)})
    out = cross_validate(rows, make("decision_tree", label="y", maxDepth=1), "y", "key", scorer=brier)
    return out.select("metric", r6("score").alias("score"))


@query(f"""
select week, {sql_r6("quantile_cont(x, 0.75) - quantile_cont(x, 0.25)")} as spread, {sql_r6("corr(x, k)")} as link
from ({SQL_EVENTS}) group by week
""")
def group_user_function(spark, sf):
    """Python functions of the rows of each week, to a number each."""
    own = {
        "spread": lambda x, k: np.quantile(x, 0.75) - np.quantile(x, 0.25),
        "link": lambda x, k: np.corrcoef(x, k)[0, 1],
    }
    out = group_scalars(_events(spark, sf), ("week",), ("x", "k"), own)
    return out.select("week", r6("spread").alias("spread"), r6("link").alias("link"))


# -- early stop ---------------------------------------------------------------

ROUND_LEVELS = 5


def _levels(spark, sf):
    """A feature of five levels, whose use differs between the rows trained on and the watched ones."""
    level = F.pmod(F.col("u").cast("int"), F.lit(ROUND_LEVELS))
    odd = (level == 1) & (F.col("x") > 0.3) | (level == 3) & (F.col("k") > 0.5) | (level == 4) & (F.col("x") > 0.6)
    rows = _events(spark, sf).select(
        "key", level.cast("double").alias("f"), (F.col("key") % 3 == 0).alias("held"),
        F.when((F.col("key") % 3 == 0) & (level == 4), ~odd).otherwise(odd).cast("double").alias("y"),
    )
    return assemble(rows, ["f"], ("key", "y", "held"))


_SQL_LEVELS = f"""
  select key, f, held, case when held and f = 4 then not odd else odd end::int as y from (
    select key, u::int % {ROUND_LEVELS} as f, key % 3 = 0 as held,
      (u::int % {ROUND_LEVELS} = 1 and x > 0.3) or (u::int % {ROUND_LEVELS} = 3 and k > 0.5) or (u::int % {ROUND_LEVELS} = 4 and x > 0.6) as odd
    from ({SQL_EVENTS}))
"""
# Boosting of one-split trees over the levels, round by round: residuals of the logistic loss
# by level, the split of least variance, its two means added (the first tree whole, later ones
# by the learning rate), and the AUC of the watched rows.
_SQL_ROUNDS = f"""
with recursive rows_ as ({_SQL_LEVELS}),
  cells as (select list(n order by f) as n, list(p order by f) as p from (
    select f, count(*)::double as n, sum(y)::double as p from rows_ where not held group by f)),
  seen as (select f, count(*) filter (y = 1)::double as pos, count(*) filter (y = 0)::double as neg from rows_ where held group by f),
  rounds as (
    select -1 as round, list_transform(n, lambda v: 0.0::double) as m, n, p from cells
    union all
    select round + 1,
      list_transform(m, lambda v, i: v + case when round < 0 then 1.0 else 0.1 end::double *
        case when i <= t then list_sum(s[:t]) / list_sum(n[:t]) else list_sum(s[t + 1:]) / list_sum(n[t + 1:]) end), n, p
    from (
      select *, list_position(gains, list_max(gains)) as t from (
        select *, list_transform(range(1, {ROUND_LEVELS}), lambda t: list_sum(s[:t]) ** 2 / list_sum(n[:t])
                    + list_sum(s[t + 1:]) ** 2 / list_sum(n[t + 1:])) as gains
        from (
          select *, case when round < 0 then list_transform(p, lambda v, i: 2 * v - n[i]) else
            list_transform(m, lambda v, i: p[i] * 4 / (1 + exp(2 * v)) - (n[i] - p[i]) * 4 / (1 + exp(-2 * v))) end as s
          from rounds where round < 99)))
  ),
  points as (select round, round(m[f + 1], 9) as s, sum(pos) as pos, sum(neg) as neg from rounds, seen where round >= 0 group by all),
  ranked as (select *, coalesce(sum(neg) over (partition by round order by s rows between unbounded preceding and 1 preceding), 0) as below
             from points),
  curve as (select round, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) as auc from ranked group by round),
  gained as (select *, coalesce(max(auc) over (order by round rows between unbounded preceding and 1 preceding), -1) as before from curve),
  lasts as (select *, max(case when auc > before + 1e-12 then round end) over (order by round) as last from gained),
  stop as (select coalesce(min(round) filter (round - last >= 10), 99) as stop from lasts)
select round::int as round, auc, round <= (select last from lasts, stop where round = stop.stop) as kept
from lasts, stop where round <= stop.stop
"""


@query(f"select round, {sql_r6('auc')} as auc, kept from ({_SQL_ROUNDS})")
def boosting_rounds(spark, sf):
    """AUC of the watched rows after each round that was looked at, and the rounds the model keeps."""
    rows = cut(_levels(spark, sf), "levels")
    watched = make("LGBMClassifier", label="y", eval_set=rows.where("held"), maxDepth=1)
    model, scores = watched.fit_and_watch(rows.where("not held"))
    kept = model.getNumTrees
    out = [(i, round(score, 6), i < kept) for i, score in enumerate(scores)]
    return spark.createDataFrame(out, "round int, auc double, kept boolean")


# -- leaderboard, then selection ----------------------------------------------


def _tens(spark, sf):
    """A feature of ten levels, so that the split of a depth-one tree is one of nine."""
    rows = _events(spark, sf).select("key", F.floor(F.col("x") * 10).cast("double").alias("f"), "y", "amount")
    return assemble(rows, ["f"], ("key", "y", "amount"))


def _sql_tens(strata: str = "") -> str:
    return f"select key, floor(x * 10)::int as f, y, amount, fold from ({_sql_folds(strata)})"


def _sql_stumps(folds: str, label: str) -> str:
    """(fold, t, low, high): the split of least squared error over the other folds, and the means on its sides."""
    return f"""
      select fold, t, lows / ln as low, highs / hn as high from (
        select *, row_number() over (partition by fold order by lows ** 2 / ln + highs ** 2 / hn desc) as place from (
          select i as fold, t, sum({label}) filter (f <= t) as lows, count(*) filter (f <= t) as ln,
                 sum({label}) filter (f > t) as highs, count(*) filter (f > t) as hn
          from ({folds}), range(5) a(i), (select distinct f as t from ({folds})) where fold <> i group by i, t)
        where ln > 0 and hn > 0) where place = 1
    """


_SQL_TEN_TREE = f"select d.*, case when f <= t then low else high end as p from ({_sql_tens('y')}) d join ({_sql_stumps(_sql_tens('y'), 'y')}) using (fold)"
_SQL_TEN_SCORES = f"""
  select 'logistic_regression' as model, avg(2 * auc - 1) as score from ({sql_auc(_sql_tens('y'), ('fold',), score='f', target='y')})
  union all
  select 'decision_tree', avg(2 * auc - 1) from ({sql_auc(_SQL_TEN_TREE, ('fold',), score='p', target='y')})
"""
_SQL_TEN_ERRORS = f"""
  with d as ({_sql_tens()}), stump as ({_sql_stumps(_sql_tens(), 'amount')}),
    line as (select i as fold, regr_slope(amount, f) as a, regr_intercept(amount, f) as b
             from d, range(5) t(i) where fold <> i group by i),
    p as (select 'linear' as model, fold, amount, a * f + b as p from d join line using (fold)
          union all select 'decision_tree', fold, amount, case when f <= t then low else high end from d join stump using (fold))
  select model, avg(score) as score from (
    select model, fold, -avg(abs(amount - p) / greatest(abs(amount), 2.220446049250313e-16)) as score from p group by model, fold)
  group by model
"""


def _staged(spark, sf, task, label, models):
    """All models are scored into the log; the one that leads there is tuned."""
    rows = cut(_tens(spark, sf), "tens")
    log = RunLog(spark, scratch_path(spark, "run-log"))
    log.append("All Models", spark.createDataFrame([("earlier", 9.0)], "model string, `metrics.gini_score` double"))
    metric = "gini_score" if task == "binary_classification" else "neg_mean_absolute_percentage_error"
    made = {n: make(n, task, label, **p) for n, p in models.items()}
    folded = write_folds(rows, label, "key", task, N_FOLDS)
    scores = log_leaderboard(log, rows, made, label, "key", task, folded=folded)
    spaces = {n: SearchSpace({"given": p}) for n, p in models.items()}
    tuned = tune_best(log, scores, rows, spaces, label, "key", 1, 1, task, folded=folded)
    first = scores.select(F.lit("leaderboard").alias("stage"), "model", r6(metric).alias("score"))
    then = [("tuned", n, round(t.best_value, 6)) for n, t in tuned.items()]
    return first.unionByName(spark.createDataFrame(then, "stage string, model string, score double"))


def _sql_staged(scores: str) -> str:
    return f"""
      with s as ({scores}) select 'leaderboard' as stage, model, {sql_r6("score")} as score from s
      union all select 'tuned', arg_max(model, score), {sql_r6("max(score)")} from s
    """


@query(_sql_staged(_SQL_TEN_SCORES))
def leaderboard_then_tuning(spark, sf):
    models = {"logistic_regression": {"regParam": 0.01}, "decision_tree": {"maxDepth": 1}}
    return _staged(spark, sf, "binary_classification", "y", models)


@query(_sql_staged(_SQL_TEN_ERRORS))
def leaderboard_then_tuning_regression(spark, sf):
    return _staged(spark, sf, "regression", "amount", {"linear": {}, "decision_tree": {"maxDepth": 1}})


@query()
def select_and_ensemble(spark, sf):
    """Families on a leaderboard, the two leading ones tuned, refitted and weighed, without a bound on trials."""
    rows = cut(ratio_split(_vectors(spark, sf, FEATURES), "6:2:2", "key"), "sets", ("split",))
    train, valid, test = (rows.where(F.col("split") == s).drop("split") for s in ("train", "valid", "test"))
    log = RunLog(spark, scratch_path(spark, "run-log"))
    spaces = {
        "decision_tree": SearchSpace({"default": {"maxDepth": 3}}, {"maxDepth": [2, 5]}),
        "logistic_regression": SearchSpace({"default": {"regParam": 0.01}}, {"regParam": [0.0, 0.1]}),
        "naive_bayes": SearchSpace({"default": {}}, {"smoothing": [0.5, 1.0]}),
    }
    found = select_model(train, valid, spaces, "y", "key", n_trials=2, log=log, top_k=2)
    return found.predict_ensemble(test, "key")


@query()
def predictions_by_family(spark, sf):
    rows = _vectors(spark, sf, FEATURES)
    settings = {
        "random_forest": {"numTrees": 5},
        "perceptron": {"layers": [3, 4, 2], "maxIter": 10},
        "gradient_boosting": {"maxIter": 3},
    }
    models = {n: make(n, label="y", **s).fit(rows) for n, s in settings.items()}
    return predictions(models, rows, "key")


# Three classes by a depth-one tree on a 0/1 feature: the most frequent class on each side.
def _three(spark, sf):
    return _events(spark, sf).select(
        "key", (F.col("x") > 0.6).cast("double").alias("f"), F.when(F.col("k") > 0.7, 2).otherwise(F.col("y")).alias("y")
    )


SQL_THREE = f"select key, (x > 0.6)::int as f, case when k > 0.7 then 2 else y end as y from ({SQL_EVENTS})"
SQL_THREE_METRICS = sql_metrics(f"""
with ranked as (select *, row_number() over (order by {sql_order("key", 42)}) as rn, count(*) over () as n from ({SQL_THREE})),
  placed as (select *, case when rn <= n - ceil(n * 4 / 10) then 'train'
               when rn <= n - ceil(ceil(n * 4 / 10) * 2 / 4) then 'valid' else 'test' end as split from ranked),
  leaf as (select f, arg_max(y, n) as p from (select f, y, count(*) as n from placed where split = 'train' group by f, y) group by f)
select split as set, y, p from placed join leaf using (f) where split <> 'valid'
""")


@query(
    " union all ".join(
        f"select set || '_{m}' as metric, {sql_r6(m)} as value from ({SQL_THREE_METRICS})" for m in METRICS
    )
)
def train_multiclass_step(spark, sf):
    out = train_and_evaluate(_three(spark, sf), "decision_tree", "6:2:2", "key", maxDepth=1)
    return out.metrics.where(~F.col("metric").startswith("baseline")).select("metric", r6("value").alias("value"))


@query(f"""
select key, x, {sql_r6("a * x + b")} as target
from ({SQL_EVENTS}), (select regr_slope(amount, x) as a, regr_intercept(amount, x) as b from ({SQL_EVENTS}))
""")
def batch_scoring(spark, sf):
    rows = _events(spark, sf).select("key", "x", "amount")
    scaler = Scale(ignore=("key",)).fit(rows)
    scaled = assemble(scaler.apply(rows), ["x"], ("amount",))
    model = make("linear", "regression", "amount").fit(scaled)
    path = scratch_path(spark, "model")
    PipelineModel([model]).write().overwrite().save(path)
    out = batch_score(rows, PipelineModel.load(path), scaler, ["x"], "amount")
    return out.select("key", "x", r6("target").alias("target"))


@query(f"select key, true as same from ({SQL_EVENTS})")
def model_roundtrip(spark, sf):
    rows = _vectors(spark, sf)
    model = make("logistic_regression", label="y").fit(rows)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    again = LogisticRegressionModel.load(path)
    both = predictions({"first": model, "second": again}, rows, "key")
    return both.select("key", (F.col("first") == F.col("second")).alias("same"))


@query(f"select 'logistic' as model, {sql_r6('avg(y)')} as \"metrics.base_rate\", count(*) as \"metrics.rows\" from ({SQL_EVENTS})")
def run_log_append(spark, sf):
    path = scratch_path(spark, "run-log")
    row = _events(spark, sf).agg(r6(F.avg("y")).alias("metrics.base_rate"), F.count("*").alias("metrics.rows"))
    append_runs(row.select(F.lit("logistic").alias("model"), "`metrics.base_rate`", "`metrics.rows`"), path)
    return read_runs(spark, path)
