"""Boosted trees that stop early: a metric after every round on watched rows, the best round kept."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml import Model
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.functions.values import col
from martloom.operators.metrics import EPSILON, auc_of_points, fit_score_ranges
from martloom.session import cut

ROUNDS = 1000  # fixed value: most rounds of a boosted family
STOPPING_ROUNDS = 10  # fixed value: rounds without gain before a fit stops
CELLS = 1 << 22  # rows times rounds worked on at once

# How a model's text shows a tree and the value of a leaf, leaves from left to right.
TREE = re.compile(r"^\s*Tree \d+ \(weight (\S+)\):$")
LEAF = re.compile(r"^\s*Predict: (\S+)$")


def leaf_values(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The weighted values of all leaves, tree after tree, and where each tree's begin."""
    begin, values, weight = [], [], 1.0
    for line in model.toDebugString.split("\n"):
        if found := TREE.match(line):
            weight = float(found[1])
            begin.append(len(values))
        elif found := LEAF.match(line):
            values.append(weight * float(found[1]))
    return np.array(values), np.array(begin)


def round_points(model: Model, rows: DataFrame) -> DataFrame:
    """(round, score, label, n): the model's scores of `rows` after each round, equal ones counted.

    Trees give few different scores, so what leaves a task is far less than rows times rounds.
    Scores of a classifier are margins, which rank rows as the probabilities do.
    """
    values, begin = leaf_values(model)
    label = model.getLabelCol()
    leaves = model.copy().setLeafCol("leaves").transform(rows.select(model.getFeaturesCol(), label))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(begin))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                y = part.column("label").to_numpy(zero_copy_only=False)
                own = part.column("leaves").flatten().to_numpy().reshape(part.num_rows, len(begin)).astype(np.int64)
                scores = np.cumsum(values[own + begin], axis=1)
                for r in range(len(begin)):
                    both, n = np.unique(np.stack([scores[:, r], y]), axis=1, return_counts=True)
                    yield pa.record_batch(
                        [pa.array(np.full(len(n), r, np.int32)), pa.array(both[0]), pa.array(both[1]), pa.array(n)],
                        ["round", "score", "label", "n"],
                    )

    table = leaves.select(vector_to_array("leaves").alias("leaves"), col(label).cast("double").alias("label"))
    out = table.where("label is not null").mapInArrow(score, "round int, score double, label double, n bigint")
    return out.groupBy("round", "score", "label").agg(F.sum("n").alias("n"))


def round_scores(model: Model, rows: DataFrame) -> list[float]:
    """A score of `rows` after each round, more being better: AUC for classes, the negated percentage error for numbers."""
    points = cut(round_points(model, rows), "rounds")
    if isinstance(model, GBTClassificationModel):
        one = F.col("label") == 1
        sides = points.groupBy("round", F.col("score").alias("s")).agg(
            F.sum(F.when(one, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(one, 0).otherwise(F.col("n"))).alias("neg")
        )
        found = auc_of_points(sides.withColumn("bad", F.lit(0)), ["round"], fit_score_ranges(points, "score"))
    else:
        y = F.abs("label")
        error = F.abs(F.col("label") - F.col("score")) / F.greatest(y, F.lit(EPSILON))
        found = points.groupBy("round").agg((-F.sum(error * F.col("n")) / F.sum("n")).alias("score"))
    held = dict(tuple(r) for r in found.collect())
    return [held[i] for i in sorted(held)]


def best_round(scores: list[float | None], patience: int = STOPPING_ROUNDS) -> tuple[int, bool]:
    """Number of rounds with the first best score before `patience` rounds bring no gain, and whether that came."""
    best = 0
    for i, score in enumerate(scores):
        if score is not None and (scores[best] is None or score > scores[best]):
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_rounds(model: Model, n: int) -> Model:
    """The model of the first `n` rounds, which later rounds leave as they are."""
    classes = isinstance(model, GBTClassificationModel)
    kind = GBTClassificationModel if classes else GBTRegressionModel
    own, context = model._java_obj, SparkContext._active_spark_context
    ml, gateway = context._jvm.org.apache.spark.ml, context._gateway
    trees, weights = own.trees(), own.treeWeights()
    kept = gateway.new_array(ml.regression.DecisionTreeRegressionModel, n)
    sizes = gateway.new_array(context._jvm.double, n)
    for i in range(n):
        kept[i], sizes[i] = trees[i], weights[i]
    if classes:
        made = ml.classification.GBTClassificationModel(own.uid(), kept, sizes, own.numFeatures(), own.numClasses())
    else:
        made = ml.regression.GBTRegressionModel(own.uid(), kept, sizes, own.numFeatures())
    return model._copyValues(kind(made))


@dataclass(frozen=True)
class Watched:
    """A boosted family that watches rows it is not trained on.

    `fit` trains, as any estimator does. Rounds are doubled until `watched` has brought no gain
    for `patience` rounds or all `rounds` are trained: a boosted model of more rounds begins
    with that of fewer, so the result is the one of training all rounds, and the last fit has
    at most twice the rounds needed. Without labelled rows to watch, or with one class of them,
    all rounds stay.
    """

    estimator: Estimator
    watched: DataFrame
    rounds: int = ROUNDS
    patience: int = STOPPING_ROUNDS
    first: int = 16

    def fit(self, rows: DataFrame) -> Model:
        return self.fit_and_watch(rows)[0]

    def fit_and_watch(self, rows: DataFrame) -> tuple[Model, list[float]]:
        """The model, and the scores of the rounds that were looked at."""
        watched = self.watched.where(col(self.estimator.getLabelCol()).isNotNull())
        if watched.isEmpty():
            return self._trained(rows, self.rounds), []
        n = min(self.first, self.rounds)
        while True:
            model = self._trained(rows, n)
            scores = round_scores(model, watched)
            if scores[0] is None:
                return self._trained(rows, self.rounds), []
            best, stopped = best_round(scores, self.patience)
            if stopped or n >= self.rounds:
                return first_rounds(model, best), scores[: best + self.patience]
            n = min(2 * n, self.rounds)

    def _trained(self, rows: DataFrame, n: int) -> Model:
        return self.estimator.copy({self.estimator.maxIter: n}).fit(rows)
