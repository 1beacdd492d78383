"""Classification, ranking, stability and regression metrics as aggregations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from martloom.functions.values import col
from martloom.session import cut

METRICS = ("accuracy", "f1", "precision", "recall")  # fixed values

# -- classification -----------------------------------------------------------


def confusion(df: DataFrame, truth: str, prediction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per (group, truth, prediction); everything below works on this small table."""
    return df.groupBy(*[col(b) for b in by], col(truth).alias("y"), col(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_metrics(df: DataFrame, truth: str, prediction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy and macro F1, precision and recall, one row per group.

    The macro mean is over the classes seen in truth or prediction; an undefined class
    score is 0.
    """
    cells = confusion(df, truth, prediction, by)
    same = F.col("y") == F.col("p")
    # One row per cell as its true class and one as its predicted class.
    sides = cells.select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.col("y").alias("label"),
                    F.when(same, F.col("n")).otherwise(0).alias("tp"),
                    F.col("n").alias("actual"),
                    F.lit(0).cast("bigint").alias("predicted"),
                ),
                F.struct(
                    F.col("p").alias("label"),
                    F.lit(0).cast("bigint").alias("tp"),
                    F.lit(0).cast("bigint").alias("actual"),
                    F.col("n").alias("predicted"),
                ),
            )
        ),
    )
    per_class = sides.groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted")
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    scores = {
        "accuracy": F.sum("tp") / F.sum("actual"),
        "f1": F.avg(ratio(2 * F.col("tp"), F.col("actual") + F.col("predicted"))),
        "precision": F.avg(ratio(F.col("tp"), F.col("predicted"))),
        "recall": F.avg(ratio(F.col("tp"), F.col("actual"))),
    }
    return per_class.groupBy(*by).agg(*[e.alias(k) for k, e in scores.items()])


def metrics_table(df: DataFrame, truth: str, prediction: str, set_column: str) -> DataFrame:
    """Long table (metric, value) with metrics named `{set}_{metric}`."""
    wide = classification_metrics(df, truth, prediction, (set_column,))
    pairs = F.array(
        *[
            F.struct(F.concat_ws("_", col(set_column), F.lit(m)).alias("metric"), F.col(m).alias("value"))
            for m in METRICS
        ]
    )
    return wide.select(F.inline(pairs))


# -- ranking ------------------------------------------------------------------

@dataclass(frozen=True)
class ScoreRanges:
    """Inner bounds of score ranges that hold about equally many rows."""

    bounds: tuple[float, ...]

    def apply(self, df: DataFrame, score: str, name: str) -> DataFrame:
        if not self.bounds:
            return df.withColumn(name, F.lit(0.0))
        splits = [float("-inf"), *self.bounds, float("inf")]
        return Bucketizer(splits=splits, inputCol=score, outputCol=name, handleInvalid="keep").transform(df)


def fit_score_ranges(df: DataFrame, score: str, ranges: int | None = None) -> ScoreRanges:
    """Quantile bounds of as many ranges as there are shuffle partitions, whatever the size of the table.

    So a range grows with the rows of a task, not with the table.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges < 2:
        return ScoreRanges(())
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    value = F.nanvl(col(score).cast("double"), F.lit(None))
    found = df.agg(F.percentile_approx(value, at, F.lit(50 * ranges)).alias("q")).first()["q"]
    return ScoreRanges(tuple(sorted(x for x in set(found or []) if math.isfinite(x))))


def auc(
    df: DataFrame, target: str, score: str, by: tuple[str, ...] = (), ranges: ScoreRanges | None = None
) -> DataFrame:
    """Exact ROC AUC per group, ties counting one half.

    Null where a class is missing or a row has no score or no target.

    Rows collapse to one per distinct score before any shuffle, scores are ranked inside
    score ranges, and the ranges are put together from their class totals, so neither a
    frequent score nor a large group is held by one task. Without given ranges the distinct
    scores are written and give them, so the rows, and the models that score them, are read once.
    """
    keys = [f"g_{i}" for i in range(len(by))]
    positive = (col(target).cast("int") == 1).cast("bigint")
    points = (
        df.select(
            *[col(b).alias(k) for b, k in zip(by, keys)],
            positive.alias("pos"),
            F.nanvl(col(score).cast("double"), F.lit(None)).alias("s"),
        )
        .groupBy(*keys, "s")
        .agg(
            F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"),
            F.coalesce(F.sum(1 - F.col("pos")), F.lit(0)).alias("neg"),
            F.count_if(F.col("s").isNull() | F.col("pos").isNull()).alias("bad"),
        )
    )
    if ranges is None:
        points = cut(points, "points")
        ranges = fit_score_ranges(points, "s")
    return auc_of_points(points, keys, ranges).withColumnsRenamed(dict(zip(keys, by)))


def auc_of_points(points: DataFrame, keys: list[str], ranges: ScoreRanges) -> DataFrame:
    """`auc` from one row per group and distinct score: (keys, s, pos, neg, bad)."""
    points = ranges.apply(points, "s", "r")
    below = W.partitionBy(*keys, "r").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    inside = points.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    totals = inside.groupBy(*keys, "r").agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("won"),
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum("bad").alias("bad"),
    )
    return auc_of_totals(totals, keys)


def auc_of_totals(totals: DataFrame, keys: list[str]) -> DataFrame:
    """`auc` from one row per group and score range: (keys, r, won, pos, neg, bad), won pairs being those within the range."""
    earlier = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    joined = totals.withColumn("earlier", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
    won = F.sum(F.col("won") + F.col("pos") * F.col("earlier"))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    found = F.when(F.sum("bad") == 0, F.try_divide(won, pairs)).alias("auc")
    return joined.groupBy(*keys).agg(found)


def with_gini(auc_table: DataFrame) -> DataFrame:
    return auc_table.withColumn("gini", 2 * F.col("auc") - 1)


def gini_by_period(
    df: DataFrame, period: str, target: str, score: str, by: tuple[str, ...] = (), ranges: ScoreRanges | None = None
) -> DataFrame:
    return with_gini(auc(df, target, score, (*by, period), ranges)).drop("auc")


# -- stability ----------------------------------------------------------------

# Fixed values: (weight of a falling trend, weight of the residual deviation).
OVER_PERIODS = (88.0, -0.5)
OVER_SCORES = (0.88, 0.5)


def stability(
    scores: DataFrame,
    order: str,
    value: str,
    weights: tuple[float, float] = OVER_SCORES,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Mean + w1 * min(0, slope) + w2 * residual deviation of a line over the position.

    Undefined periods are left out; with one period the slope is null and so the result.
    """
    keys = [col(b) for b in by]
    # One row per period reaches this window.
    position = F.row_number().over(W.partitionBy(*keys).orderBy(col(order))) - 1
    placed = scores.where(col(value).isNotNull()).withColumn("x", position.cast("double"))
    y = col(value).cast("double")
    slope = F.regr_slope(y, F.col("x"))
    # Residual variance of a least-squares line.
    left = F.greatest(F.var_pop(y) - slope * F.covar_pop(F.col("x"), y), F.lit(0.0))
    falling, spread = weights
    out = placed.groupBy(*keys).agg(F.avg(y).alias("mean"), slope.alias("slope"), F.sqrt(left).alias("residual_std"))
    total = F.col("mean") + falling * F.least(F.lit(0.0), F.col("slope")) + spread * F.col("residual_std")
    return out.withColumn("stability", F.when(F.col("slope").isNotNull(), total))


def gini_stability(
    df: DataFrame,
    period: str,
    target: str,
    score: str,
    weights: tuple[float, float] = OVER_PERIODS,
    by: tuple[str, ...] = (),
) -> DataFrame:
    return stability(gini_by_period(df, period, target, score, by), period, "gini", weights, by)


def attach_scores(base: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """The stored base table with new scores by key; a row without one gets a null score."""
    return base.join(scores, key, "left")


# -- regression ---------------------------------------------------------------

EPSILON = 2.220446049250313e-16  # fixed value: floor of |y| in the percentage error


def regression_metrics(df: DataFrame, truth: str, prediction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Negated errors and r2 per group, in one aggregation."""
    y, p = col(truth).cast("double"), col(prediction).cast("double")
    e = y - p
    mse = F.avg(e * e)
    return df.groupBy(*[col(b) for b in by]).agg(
        (-mse).alias("neg_mean_squared_error"),
        (-F.sqrt(mse)).alias("neg_root_mean_squared_error"),
        (-F.avg(F.abs(e))).alias("neg_mean_absolute_error"),
        (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"),
        (-F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPSILON)))).alias("neg_mean_absolute_percentage_error"),
    )


# -- functions of the caller --------------------------------------------------


def group_scalars(
    df: DataFrame, by: tuple[str, ...], columns: tuple[str, ...], functions: dict[str, Callable[..., float]]
) -> DataFrame:
    """(by, one number per function): each Python function gets the group's `columns` as numpy arrays.

    Nulls arrive as NaN; a function that gives None or NaN gives null. Each group is in one
    task; aggregates that Spark has should be used instead where there are any.
    """

    def one(function: Callable[..., float]) -> Callable:
        def call(*series: pd.Series) -> float:
            value = function(*[s.to_numpy() for s in series])
            return math.nan if value is None else float(value)

        return F.pandas_udf(call, "double")

    found = [F.nanvl(one(f)(*[col(c) for c in columns]), F.lit(None)).alias(n) for n, f in functions.items()]
    return df.groupBy(*[col(b) for b in by]).agg(*found)


# -- leaderboards -------------------------------------------------------------


def mean_scores(fold_scores: DataFrame, by: tuple[str, ...], value: str = "score") -> DataFrame:
    return fold_scores.groupBy(*by).agg(F.avg(value).alias(value))


def top_models(scores: DataFrame, metric: str, k: int) -> DataFrame:
    """The k best rows, ties by model name."""
    return scores.orderBy(col(metric).desc_nulls_last(), "model").limit(k)


def best_model(scores: DataFrame, metric: str, direction: str = "max") -> DataFrame:
    pick, edge = (F.max_by, F.max) if direction == "max" else (F.min_by, F.min)
    return scores.agg(pick("model", col(metric)).alias("model"), edge(col(metric)).alias(metric))
