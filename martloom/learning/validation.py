"""Cross-validation, expanding-window validation and the leaderboard."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions.values import col
from martloom.operators.metrics import (
    OVER_SCORES,
    auc,
    group_scalars,
    mean_scores,
    regression_metrics,
    stability,
    with_gini,
)
from martloom.operators.splits import SEED, folds, stratified_folds
from martloom.session import cut

N_FOLDS = 5  # fixed value
# Models trained side by side; each is itself a distributed job.
PARALLEL = 4


def score_column(scored: DataFrame) -> Column:
    """Probability of class 1, the logistic of the margin of a machine without one, or the value.

    All lie between 0 and 1 and rank rows as the model does, so they can be averaged.
    """
    if "probability" in scored.columns:
        return vector_to_array("probability")[1]
    if "rawPrediction" in scored.columns:
        return 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return F.col("prediction")


def in_parallel(spark, function: Callable, items: list, workers: int = PARALLEL) -> list:
    """Run `function` on each item in driver threads that share the session's settings."""
    with ThreadPoolExecutor(min(workers, max(1, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(function), items))


def write_folds(df: DataFrame, label: str, key: str, task: str, k: int, seed: int = SEED) -> DataFrame:
    """The table with its fold column, written by fold: a fit scans only its own folds."""
    folded = stratified_folds(df, label, k, key, seed) if task == "binary_classification" else folds(df, k, key, seed)
    return cut(folded, "folds", ("fold",))


def out_of_fold(
    folded: DataFrame, estimators: list[Estimator], label: str, k: int, deadline: float | None = None
) -> DataFrame | None:
    """(trial, fold, label, score): every row scored by models that did not see its fold.

    One pool works through the (trial, fold) jobs in order. Jobs that could only begin after
    `deadline` are left out, and with them their trial; None where no trial is whole.
    """

    def one(job: tuple[int, int]) -> DataFrame | None:
        trial, i = job
        if deadline is not None and time.time() > deadline:
            return None
        model = estimators[trial].fit(folded.where(F.col("fold") != i))
        scored = model.transform(folded.where(F.col("fold") == i))
        return scored.select(F.lit(trial).alias("trial"), "fold", col(label), score_column(scored).alias("score"))

    jobs = [(t, i) for t in range(len(estimators)) for i in range(k)]
    done = in_parallel(folded.sparkSession, one, jobs)
    cut_off = {t for (t, _), df in zip(jobs, done, strict=True) if df is None}
    whole = [df for (t, _), df in zip(jobs, done, strict=True) if t not in cut_off]
    return reduce(DataFrame.unionByName, whole) if whole else None


def classification_scores(scored: DataFrame, label: str, by: tuple[str, ...]) -> DataFrame:
    """(by, metric, score) for AUC and Gini."""
    table = with_gini(auc(scored, label, "score", by))
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("score")) for n, c in
                      (("roc_auc_score", "auc"), ("gini_score", "gini"))])
    return table.select(*by, F.inline(pairs))


def regression_scores(scored: DataFrame, label: str, by: tuple[str, ...]) -> DataFrame:
    """(by, metric, score) for the regression metrics."""
    table = regression_metrics(scored, label, "score", by)
    names = [c for c in table.columns if c not in by]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("score")) for n in names])
    return table.select(*by, F.inline(pairs))


# Task -> table of (by, metric, score) from scored rows. A caller may pass a function of
# the same shape with scores of their own.
Scorer = Callable[[DataFrame, str, tuple[str, ...]], DataFrame]
SCORERS: dict[str, Scorer] = {"binary_classification": classification_scores, "regression": regression_scores}


def score_columns(functions: dict[str, Callable[[Column, Column], Column]]) -> Scorer:
    """A scorer from aggregate expressions of (label, score); Spark adds them up in parts."""

    def scorer(scored: DataFrame, label: str, by: tuple[str, ...]) -> DataFrame:
        y, p = col(label).cast("double"), col("score")
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), col(n).alias("score")) for n in functions])
        found = scored.groupBy(*by).agg(*[f(y, p).cast("double").alias(n) for n, f in functions.items()])
        return found.select(*by, F.inline(pairs))

    return scorer


def score_functions(functions: dict[str, Callable[[np.ndarray, np.ndarray], float]]) -> Scorer:
    """A scorer from named Python functions of all labels and scores of a fold, as numpy arrays.

    Such a function sees a whole fold at once, so a fold must fit into the memory of a task;
    what can be written as an aggregate expression belongs into `score_columns`.
    """

    def scorer(scored: DataFrame, label: str, by: tuple[str, ...]) -> DataFrame:
        rows = scored.select(*by, col(label).cast("double").alias("y"), F.col("score"))
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), col(n).alias("score")) for n in functions])
        return group_scalars(rows, by, ("y", "score"), functions).select(*by, F.inline(pairs))

    return scorer


def score_trials(
    folded: DataFrame, estimators: list[Estimator], label: str, task: str, k: int, scorer: Scorer | None = None,
    deadline: float | None = None,
) -> DataFrame:
    """(trial, metric, score): fold scores of each estimator averaged over the folds."""
    scored = out_of_fold(folded, estimators, label, k, deadline)
    if scored is None:
        return folded.sparkSession.createDataFrame([], "trial int, metric string, score double")
    rows = (scorer or SCORERS[task])(scored, label, ("trial", "fold"))
    return mean_scores(rows, ("trial", "metric"))


def cross_validate(
    df: DataFrame,
    estimator: Estimator,
    label: str,
    key: str,
    task: str = "binary_classification",
    k: int = N_FOLDS,
    scorer: Scorer | None = None,
) -> DataFrame:
    """(metric, score): mean over folds; folds are stratified by label for classification."""
    folded = write_folds(df, label, key, task, k)
    return score_trials(folded, [estimator], label, task, k, scorer).drop("trial")


def temporal_validate(
    df: DataFrame,
    estimator: Estimator,
    label: str,
    period: str,
    weights: tuple[float, float] = OVER_SCORES,
    hard: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(gini per step, stability): each period from the second on is scored by a model
    trained on all periods before it. `hard` scores by predicted class."""
    data = cut(df, "periods", (period,))
    periods = [r[0] for r in data.select(col(period)).distinct().orderBy(col(period)).collect()]

    def step(week) -> DataFrame:
        model = estimator.fit(data.where(col(period) < F.lit(week)))
        scored = model.transform(data.where(col(period) == F.lit(week)))
        value = F.col("prediction") if hard else score_column(scored)
        return scored.select(col(label), col(period).alias("period"), value.alias("score"))

    scored = reduce(DataFrame.unionByName, in_parallel(df.sparkSession, step, periods[1:]))
    # One row per period, read twice: by the caller and by the stability.
    steps = cut(with_gini(auc(scored, label, "score", ("period",))).select("period", "gini"), "steps")
    return steps, stability(steps, "period", "gini", weights)


def leaderboard(
    df: DataFrame,
    models: dict[str, Estimator],
    label: str,
    key: str,
    task: str = "binary_classification",
    k: int = N_FOLDS,
    scorer: Scorer | None = None,
    folded: DataFrame | None = None,
) -> DataFrame:
    """One row per model with its mean score per metric; all models share one set of folds, that of `folded` where it is written."""
    folded = write_folds(df, label, key, task, k) if folded is None else folded
    scores = score_trials(folded, list(models.values()), label, task, k, scorer)
    names = F.array(*[F.lit(n) for n in models])
    named = scores.select(names[F.col("trial")].alias("model"), "metric", "score")
    return named.groupBy("model").pivot("metric").agg(F.first("score"))
