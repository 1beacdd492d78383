"""Hyperparameter trials: a trial table scored by cross-validation in batches."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.learning.registry import make
from martloom.learning.validation import N_FOLDS, PARALLEL, score_trials, write_folds
from martloom.sources.runs import RunLog

# Fixed value: trials without gain before tuning stops.
PATIENCE = 5000


@dataclass(frozen=True)
class SearchSpace:
    """Trials tried first, and the ranges further trials are drawn from.

    A range of texts or booleans is a choice, of two integers an integer interval, of
    other numbers a float interval.
    """

    base: dict[str, dict] = field(default_factory=dict)
    ranges: dict[str, list] = field(default_factory=dict)

    def draw(self, rng: random.Random) -> dict:
        out = {}
        for name, values in self.ranges.items():
            if any(isinstance(v, str | bool) for v in values):
                out[name] = rng.choice(values)
            elif all(isinstance(v, int) for v in values):
                out[name] = rng.randint(min(values), max(values))
            elif all(isinstance(v, int | float) for v in values):
                out[name] = rng.uniform(min(values), max(values))
            else:
                raise TypeError(f"range of {name} mixes kinds: {values}")
        return out

    def trials(self, n: int, seed: int = 42) -> Iterator[dict]:
        """`n` trials: the base trials in order, then seeded draws."""
        rng, given = random.Random(seed), list(self.base.values())
        for i in range(n):
            yield given[i] if i < len(given) else self.draw(rng)


# Start trials and ranges of the three boosted families, in MLlib's parameter names. Fixed
# values where the parameter means the same: rounds, learning rate, depth, leaf size, row
# share, feature share. A family without a depth of its own and 31 leaves has depth 5; what
# MLlib's trees have no counterpart of (penalties on leaves, binning and sampling modes) is left out.
SPACES = {
    "LGBMClassifier": SearchSpace(
        base={
            "default": {"maxIter": 1000, "stepSize": 0.1, "maxDepth": 5, "minInstancesPerNode": 20, "subsamplingRate": 1.0, "featureSubsetStrategy": 1.0},
            "best_found": {"maxIter": 1000, "stepSize": 0.08767009868144243, "maxDepth": 20, "minInstancesPerNode": 7, "subsamplingRate": 0.547070560433649, "featureSubsetStrategy": 0.8248602702109634},
            "best_small": {"maxIter": 1000, "stepSize": 0.07993103759008606, "maxDepth": 7, "minInstancesPerNode": 40, "subsamplingRate": 0.9604966139592431, "featureSubsetStrategy": 0.9767610734651145},
            "best_medium": {"maxIter": 1000, "stepSize": 0.0864683107775281, "maxDepth": 16, "minInstancesPerNode": 13, "subsamplingRate": 0.9382635709045782, "featureSubsetStrategy": 0.9548993839554839},
        },
        ranges={"maxIter": [1000, 1000], "stepSize": [1e-5, 0.1], "maxDepth": [1, 20], "minInstancesPerNode": [1, 40], "subsamplingRate": [0.5, 1.0], "featureSubsetStrategy": [0.8, 1.0]},
    ),
    "CatBoostClassifier": SearchSpace(
        base={
            "default": {"maxIter": 1000, "stepSize": 0.0637660026550293, "maxDepth": 6, "subsamplingRate": 0.800000011920929, "featureSubsetStrategy": 1.0},
            "best_medium": {"maxIter": 1001, "stepSize": 0.05231818503720738, "maxDepth": 5, "subsamplingRate": 0.9754678706761962, "featureSubsetStrategy": 0.8018879912718615},
        },
        ranges={"maxIter": [1000, 1000], "stepSize": [1e-5, 0.3], "maxDepth": [5, 10], "subsamplingRate": [0.8, 1.0], "featureSubsetStrategy": [0.1, 1.0]},
    ),
    "XGBClassifier": SearchSpace(
        base={
            "default": {"maxIter": 1000, "stepSize": 0.299, "maxDepth": 6, "subsamplingRate": 1.0},
            "best_medium": {"maxIter": 896, "stepSize": 0.05476444099818623, "maxDepth": 12, "subsamplingRate": 0.9708888129698929, "featureSubsetStrategy": 0.6314127701702026},
        },
        ranges={"maxIter": [500, 2000], "stepSize": [1e-5, 0.3], "maxDepth": [1, 16], "subsamplingRate": [0.8, 1.0], "featureSubsetStrategy": [0.1, 1.0]},
    ),
}


@dataclass(frozen=True)
class Tuning:
    best_params: dict
    best_value: float
    trials: DataFrame


def tune(
    df: DataFrame,
    name: str,
    space: SearchSpace,
    label: str,
    key: str,
    n_trials: int,
    task: str = "binary_classification",
    timeout_hours: float = 100.0,
    patience: int = PATIENCE,
    k: int = N_FOLDS,
    seed: int = 42,
    run_log: str | None = None,
    features: str = "features",
    eval_set: DataFrame | None = None,
    folded: DataFrame | None = None,
) -> Tuning:
    """Score trials by a mean fold score, higher being better, until a stop rule holds.

    The score is the Gini, or the negated percentage error for regression. All trials
    share one set of folds (`folded`, where the caller has written them), and every fit of a watching family stops early on `eval_set`.
    The time limit holds for each fit: one that would begin after it is left out, with its
    trial. Between batches the number of trials without gain is checked.
    """
    metric = "gini_score" if task == "binary_classification" else "neg_mean_absolute_percentage_error"
    folded = write_folds(df, label, key, task, k, seed) if folded is None else folded
    deadline, rows, best = time.time() + 3600 * timeout_hours, [], None
    queue = list(space.trials(n_trials, seed))
    for start in range(0, len(queue), PARALLEL):
        if time.time() > deadline or (best and start - best[0] > patience):
            break
        batch, clock = queue[start : start + PARALLEL], time.time()
        estimators = [make(name, task, label, features, eval_set, **params) for params in batch]
        found = score_trials(folded, estimators, label, task, k, deadline=deadline).where(F.col("metric") == metric).collect()
        values = {r["trial"]: r["score"] for r in found}
        seconds = (time.time() - clock) / len(batch)
        for i, params in enumerate(batch):
            score = values.get(i)
            rows.append((start + i, name, json.dumps(params, sort_keys=True), score, seconds))
            if score is not None and (best is None or score > best[1]):
                best = (start + i, score, params)
    if best is None:
        raise ValueError("no trial could be scored")
    schema = f"trial_id int, model string, params string, `metrics.{metric}` double, `metrics.time_in_seconds` double"
    trials = df.sparkSession.createDataFrame(rows, schema)
    if run_log:
        RunLog(df.sparkSession, run_log).append(name, trials)
    return Tuning(best[2], best[1], trials)
