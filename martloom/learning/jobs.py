"""Training, selection and scoring jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.functions.values import col
from martloom.learning.registry import baseline, make, make_for_classes
from martloom.learning.tuning import SPACES, SearchSpace, Tuning, tune
from martloom.learning.validation import N_FOLDS, Scorer, leaderboard, score_column, write_folds
from martloom.operators.ensemble import Search, search_weights, weighted_mean, weighted_sum
from martloom.operators.metrics import OVER_PERIODS, auc, gini_stability, metrics_table, top_models
from martloom.operators.scaling import ScalePlan
from martloom.operators.splits import ladder_sample, ratio_split
from martloom.plans.mart import assemble
from martloom.session import cut
from martloom.sources.runs import RunLog

# -- train and evaluate -------------------------------------------------------


@dataclass(frozen=True)
class Trained:
    model: Model
    baseline: Model
    metrics: DataFrame


def train_and_evaluate(
    df: DataFrame, name: str, ratio: str, key: str, label: str = "y", features: list[str] | None = None, **params
) -> Trained:
    """Split by ratio, train the named classifier with early stopping, compare sets.

    Metrics cover the train and test rows and, as the set `baseline`, the test rows
    predicted by a one-vs-rest logistic regression.
    """
    features = features or [c for c in df.columns if c not in (label, key)]
    sets = assemble(ratio_split(df, ratio, key), features, (key, label, "split"))
    sets = sets.withColumn("held", F.col("split") == "valid").withColumn(label, F.col(label).cast("double"))
    n_classes = int(sets.agg(F.max(label)).first()[0]) + 1
    sets = cut(sets, "sets")
    model = make_for_classes(name, n_classes, label, eval_set=sets.where("held"), **params).fit(sets.where("split = 'train'"))
    plain = baseline(label).fit(sets.where("split = 'train'"))
    seen = model.transform(sets.where("split <> 'valid'")).select(F.col("split").alias("set"), label, "prediction")
    other = plain.transform(sets.where("split = 'test'")).select(F.lit("baseline").alias("set"), label, "prediction")
    return Trained(model, plain, metrics_table(seen.unionByName(other), label, "prediction", "set"))


def train_from(spark: SparkSession, uri: str, name: str, ratio: str, key: str, label: str = "y", **params) -> Trained:
    return train_and_evaluate(spark.read.parquet(uri), name, ratio, key, label, **params)


def tune_from(
    spark: SparkSession, uri: str, name: str, ratio: str, key: str, label: str = "y", n_trials: int = 1,
    timeout_hours: float = 100.0, space: SearchSpace | None = None, run_log: str | None = None, **settings,
) -> Tuning:
    """Tune the named classifier on the train rows of a stored table; fits stop early on its validation rows."""
    df = spark.read.parquet(uri)
    features = [c for c in df.columns if c not in (label, key)]
    sets = cut(assemble(ratio_split(df, ratio, key), features, (key, label, "split")), "sets", ("split",))
    train, valid = (sets.where(F.col("split") == s).drop("split") for s in ("train", "valid"))
    return tune(train, name, space or SPACES[name], label, key, n_trials, timeout_hours=timeout_hours,
                run_log=run_log, eval_set=valid, **settings)


# -- leaderboard --------------------------------------------------------------

EXPERIMENT = "All Models"  # fixed value: what the runs of a leaderboard are filed under


def log_leaderboard(
    log: RunLog, df: DataFrame, models: dict[str, object], label: str, key: str, task: str = "binary_classification",
    k: int = N_FOLDS, scorer: Scorer | None = None, experiment: str = EXPERIMENT, folded: DataFrame | None = None,
) -> DataFrame:
    """Cross-validate every model, add a run each to the log, and read the scores back from it."""
    moment = log.now()
    board = leaderboard(df, models, label, key, task, k, scorer, folded)
    log.append(experiment, board.withColumnsRenamed({c: f"metrics.{c}" for c in board.columns if c != "model"}))
    return log.scores(experiment, moment)


def tuning_metric(task: str) -> str:
    return "gini_score" if task == "binary_classification" else "neg_mean_absolute_percentage_error"


def tune_best(
    log: RunLog, scores: DataFrame, df: DataFrame, spaces: dict[str, SearchSpace], label: str, key: str, top_k: int = 3,
    n_trials: int = 1, task: str = "binary_classification", **settings,
) -> dict[str, Tuning]:
    """Tune the `top_k` models that lead the leaderboard; their trials go to the log as well."""
    names = [r.model for r in top_models(scores, tuning_metric(task), top_k).select("model").collect()]
    return {n: tune(df, n, spaces[n], label, key, n_trials, task, run_log=log.path, **settings) for n in names}


# -- select and ensemble ------------------------------------------------------


@dataclass(frozen=True)
class Selection:
    """Tuned models refitted on all training rows, the best of them, and the ensemble."""

    models: dict[str, Model]
    best: str
    tuned: dict[str, Tuning]
    weights: Search
    task: str

    def predict(self, df: DataFrame) -> DataFrame:
        return self.models[self.best].transform(df)

    def predict_each(self, df: DataFrame, key: str) -> DataFrame:
        """(key, one prediction column per model)."""
        return predictions(self.models, df, key)

    def predict_ensemble(self, df: DataFrame, key: str) -> DataFrame:
        """(key, score): weighted mean for classification, weighted sum for regression."""
        combine = weighted_mean if self.task == "binary_classification" else weighted_sum
        names = list(self.models)
        return self.predict_each(df, key).select(col(key), combine(names, self.weights.weights).alias("score"))


def predictions(models: dict[str, Model], df: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One column per model, beside the key and the columns to `keep`. The models score the same rows one after the other, so no
    join of their predictions is needed."""
    out = df
    for name, model in models.items():
        scored = model.transform(out)
        added = [c for c in scored.columns if c not in out.columns]
        out = scored.withColumn(name, score_column(scored)).drop(*added)
    return out.select(col(key), *[col(c) for c in keep], *[col(n) for n in models])


def select_model(
    train: DataFrame,
    valid: DataFrame,
    spaces: dict[str, SearchSpace],
    label: str,
    key: str,
    n_trials: int = 1,
    task: str = "binary_classification",
    rung: str = "full",
    n_features: int = 1,
    k: int = N_FOLDS,
    max_ensemble_trials: int | None = None,
    direction: str = "max",
    run_log: str | None = None,
    log: RunLog | None = None,
    top_k: int | None = None,
) -> Selection:
    """Sample a rung, choose and tune families on it, refit on all training rows, weigh, pick.

    With `top_k` a leaderboard of all families comes first; it is kept in `log`, and only the
    models that lead it are tuned. `direction` is that of the best model's score; `min` picks
    the lowest score. Watching families stop early on `valid` in every fit.
    """
    train, valid = cut(train, "train"), cut(valid, "valid")
    sample = ladder_sample(train, rung, label, key, n_features) if task == "binary_classification" else train
    # The leaderboard and the tuning of every family look at the same folds.
    folded = write_folds(sample, label, key, task, k)
    if top_k is None:
        tuned = {
            n: tune(sample, n, s, label, key, n_trials, task, k=k, run_log=run_log, eval_set=valid, folded=folded)
            for n, s in spaces.items()
        }
    else:
        models = {n: make(n, task, label, eval_set=valid) for n in spaces}
        scores = log_leaderboard(log, sample, models, label, key, task, k, folded=folded)
        tuned = tune_best(log, scores, sample, spaces, label, key, top_k, n_trials, task, k=k, eval_set=valid, folded=folded)
    models = {n: make(n, task, label, eval_set=valid, **t.best_params).fit(train) for n, t in tuned.items()}
    scored = cut(predictions(models, valid.select(key, label, "features"), key, (label,)), "predictions")
    weights = search_weights(scored, label, list(models), task, max_trials=max_ensemble_trials)
    pick: Callable = max if direction == "max" else min
    best = pick(tuned, key=lambda n: tuned[n].best_value)
    return Selection(models, best, tuned, weights, task)


def evaluate_sets(df: DataFrame, target: str, score: str, period: str, set_column: str = "split") -> DataFrame:
    """(set, auc, stability) for rows scored on every set."""
    ranked = auc(df, target, score, (set_column,))
    steady = gini_stability(df, period, target, score, OVER_PERIODS, (set_column,)).select(set_column, "stability")
    return ranked.join(steady, set_column, "left")


# -- batch scoring ------------------------------------------------------------


def batch_score(
    df: DataFrame, model: Model, scaler: ScalePlan, features: list[str], target: str, features_column: str = "features"
) -> DataFrame:
    """All rows with `target`: scale the features, predict, undo the target's scaling."""
    marked = df.select(F.struct(*[col(c) for c in df.columns]).alias("__row"), *[col(c) for c in df.columns])
    scaled = assemble(scaler.apply(marked), features, ("__row",), features_column)
    scored = model.transform(scaled)
    out = scaler.inverse(F.col("prediction"), target)
    kept = [F.col("__row").getField(c).alias(c) for c in df.columns if c != "target"]
    return scored.select(*kept, out.alias("target"))

