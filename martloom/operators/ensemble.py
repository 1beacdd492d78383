"""Weighted ensembles and the search for their weights."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby, islice, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions.values import col
from martloom.operators.metrics import EPSILON, auc_of_totals
from martloom.session import cut, side_by_side

Weights = tuple[float, ...]
# (table, target, models, trials) -> (trial, score)
Evaluate = Callable[[DataFrame, str, list[str], list[Weights]], DataFrame]

GRID = (-1.0, 0.0, 1.0)  # fixed values: weights every combination is tried of
PATIENCE = 1000  # fixed value: trials without gain before the search stops


def weighted_sum(models: list[str], weights: Weights) -> Column:
    total = F.lit(0.0)
    for m, w in zip(models, weights):
        total = total + F.lit(float(w)) * col(m)
    return total


def weighted_mean(models: list[str], weights: Weights) -> Column:
    return weighted_sum(models, weights) / F.lit(len(models))


def plain_mean(models: list[str]) -> Column:
    return weighted_mean(models, (1.0,) * len(models))


def wide_predictions(predictions: dict[str, DataFrame], key: str, value: str = "score") -> DataFrame:
    """One column per model from per-model (key, value) tables; a missing prediction is null."""
    out = None
    for name, table in predictions.items():
        part = table.select(key, col(value).alias(name))
        out = part if out is None else out.join(part, key, "full")
    return out


def grid(n_models: int) -> list[Weights]:
    return [tuple(c) for c in product(GRID, repeat=n_models)]


def draws(n_models: int, seed: int = 42) -> Iterator[Weights]:
    """Endless seeded draws in [-1, 1]."""
    rng = random.Random(seed)
    while True:
        yield tuple(rng.uniform(-1.0, 1.0) for _ in range(n_models))


def _leading_sign(w: Weights) -> int:
    return next((1 if x > 0 else -1 for x in w if x), 0)


# -- scores in tasks ----------------------------------------------------------

EDGE_ROWS = 1 << 16  # rows that borders of scores are taken from; any borders give true bounds and exact ranks
ENDS_ROWS = 1 << 14  # of these, rows the ends of a trial's cells are taken from
BLOCK_BYTES = 1 << 14  # Spark reads 4096 blocks at once
ROWS_AT_ONCE = 1 << 17  # rows a task holds while it goes through the trials
HUGE = 1e300  # sums of smaller values stay finite


def weighted_scores(
    values: list[np.ndarray], weights: Weights, out: np.ndarray | None = None, spare: np.ndarray | None = None
) -> np.ndarray:
    """`weighted_mean` over arrays, in the same order of operations; it needs no new memory where `out` and `spare` are given."""
    total = np.multiply(values[0], weights[0], out=out)
    for v, w in zip(values[1:], weights[1:], strict=True):
        total += np.multiply(v, w, out=spare)
    total /= len(values)
    return total


def edge_rows(df: DataFrame, models: list[str], seed: int = 42) -> list[np.ndarray]:
    """At most `EDGE_ROWS` rows of the predictions, drawn at random and in random order."""
    share = 1.1 * EDGE_ROWS / max(df.count(), 1)
    drawn = df.where(F.rand(seed) < share) if share < 1 else df
    rows = drawn.select(*[col(m).cast("double").alias(f"m{i}") for i, m in enumerate(models)]).dropna().toArrow()
    order = np.random.default_rng(seed).permutation(rows.num_rows)[:EDGE_ROWS]
    return [rows.column(i).to_numpy()[order] for i in range(len(models))]


def finite_scores(sample: list[np.ndarray], weights: Weights) -> np.ndarray:
    with np.errstate(all="ignore"):
        scores = weighted_scores(sample, weights)
    return scores[np.isfinite(scores)]


@dataclass(frozen=True)
class Packed:
    """Predictions as blocks: a row holds up to `BLOCK_BYTES` of them, the values of the negative rows model by model, then
    those of the positive rows. Handing rows to Python one by one costs more than a hundred trials."""

    blocks: DataFrame


def packed(df: DataFrame | Packed, target: str, models: list[str]) -> Packed:
    """Rows without a target or a value, which no trial can score, are only counted."""
    if isinstance(df, Packed):
        return df

    size = max(1, BLOCK_BYTES // (8 * len(models)))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for start in range(0, batch.num_rows, size):
                y, *values = [c.to_numpy(zero_copy_only=False) for c in batch.slice(start, size).columns]
                values = np.array(values)
                known = (y >= 0) & ~np.isnan(values).any(axis=0)
                neg, pos = values[:, known & (y == 0)], values[:, known & (y == 1)]
                blocks.append((neg.shape[1], pos.shape[1], neg.tobytes() + pos.tobytes(), len(y) - int(known.sum())))
            yield _batch(blocks, BLOCKS)

    y = F.coalesce((col(target).cast("int") == 1).cast("int"), F.lit(-1)).alias("y")
    rows = df.select(y, *[F.nanvl(col(m).cast("double"), F.lit(None)).alias(f"m{i}") for i, m in enumerate(models)])
    return Packed(_spread(rows).mapInArrow(pack, _ddl(BLOCKS)))


def _spread(rows: DataFrame) -> DataFrame:
    """A small file has few partitions, and each row is worked on for every trial."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def _chunks(batches: Iterable[pa.RecordBatch], n_models: int) -> Iterator[Scorer]:
    """`ROWS_AT_ONCE` rows of packed predictions at a time."""

    def joined(held: list[dict]) -> Scorer:
        neg, pos = [], []
        for r in held:
            values, at = np.frombuffer(r["rows"]), r["neg"] * n_models
            neg.append(values[:at].reshape(n_models, -1))
            pos.append(values[at:].reshape(n_models, -1))
        return Scorer(np.concatenate(neg + pos, axis=1), sum(r["neg"] for r in held), sum(r["bad"] for r in held))

    held, n = [], 0
    for r in (r for batch in batches for r in _rows(batch)):
        held.append(r)
        n += r["neg"] + r["pos"]
        if n >= ROWS_AT_ONCE:
            yield joined(held)
            held, n = [], 0
    if held:
        yield joined(held)


class Scorer:
    """Scores of trials over the same rows, `neg` negative ones and then the positive ones, in memory taken once."""

    def __init__(self, values: np.ndarray, neg: int, lost: int):
        self.values, self.n, self.neg, self.lost = list(values), values.shape[1], neg, lost
        self.out, self.spare = np.empty(self.n), np.empty(self.n)
        self.tame = not self.n or max(-values.min(), values.max()) < HUGE

    def scores(self, weights: Weights) -> tuple[np.ndarray, int]:
        """Scores, valid until the next call, and the number of rows without one. Values without a bound may cancel out
        or be weighted by zero."""
        if self.tame:
            return weighted_scores(self.values, weights, self.out, self.spare), self.lost
        with np.errstate(all="ignore"):
            found = weighted_scores(self.values, weights, self.out, self.spare)
        bad = np.isnan(found)
        found[bad] = 0.0
        return found, self.lost + int(bad.sum())


# -- exact ranks --------------------------------------------------------------


def gini_of_weights(
    df: DataFrame | Packed, target: str, models: list[str], trials: list[Weights], sample: list[np.ndarray] | None = None
) -> DataFrame:
    """(trial, gini) of the weighted mean for every weight vector.

    Opposite weights rank rows in opposite order, so only one of each such pair is
    ranked and the other gets the negated score. Each task sorts the scores of a ranked trial,
    collapses them to distinct ones and cuts them into as many ranges as there are shuffle
    partitions, at quantiles of `sample` (by default that of `edge_rows`); the parts of a range are
    ranked together. Null where a class is missing or a row has no score or no target.
    """
    chosen: dict[Weights, int] = {}
    links = []
    for i, w in enumerate(trials):
        sign = _leading_sign(w)
        lead = w if sign >= 0 else tuple(-x for x in w)
        lead = tuple(x + 0.0 for x in lead)
        links.append((i, chosen.setdefault(lead, len(chosen)), float(sign if sign else 1)))
    sample = edge_rows(df, models) if sample is None else sample
    blocks, leads = packed(df, target, models).blocks, list(chosen)
    spark = blocks.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = []
    for w in leads:
        scores = finite_scores(sample, w)
        edges.append(np.unique(np.quantile(scores, np.arange(1, ranges) / ranges, method="lower")) if len(scores) else scores)

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, len(models)):
            for j, w in enumerate(leads):
                (scores, bad), cells = chunk.scores(w), []
                for part in (scores[: chunk.neg], scores[chunk.neg :]):
                    found, counts = np.unique(part, return_counts=True)
                    at = [0, *np.searchsorted(found, edges[j], "left"), len(found)]
                    cells.append([(found[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(at, at[1:])])
                rows = [(j, r, *neg, *pos, 0) for r, (neg, pos) in enumerate(zip(*cells, strict=True)) if neg[0] or pos[0]]
                yield _batch([*rows, (j, 0, b"", b"", b"", b"", bad)] if bad else rows, PARTS)

    def ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (tuple(r.values()) for batch in batches for r in _rows(batch))
        for (j, r), group in groupby(found, key=lambda x: x[:2]):
            columns = list(zip(*[x[2:] for x in group], strict=True))
            neg, neg_n, pos, pos_n = [np.frombuffer(b"".join(c), k) for c, k in zip(columns, (np.float64, np.int64) * 2)]
            order = np.argsort(neg, kind="stable")
            neg, upto = neg[order], np.concatenate([[0], np.cumsum(neg_n[order])])
            below = (upto[np.searchsorted(neg, pos, "left")] + upto[np.searchsorted(neg, pos, "right")]) / 2
            yield _batch([(j, float(r), float(pos_n @ below), int(pos_n.sum()), int(upto[-1]), sum(columns[4]))], TOTALS)

    cut_up = blocks.mapInArrow(parts, _ddl(PARTS)).repartition(ranges, "rank_id", "r")
    totals = cut_up.sortWithinPartitions("rank_id", "r").mapInArrow(ranked, _ddl(TOTALS))
    pairs = spark.createDataFrame(links, "trial int, rank_id int, sign double")
    return auc_of_totals(totals, ["rank_id"]).join(F.broadcast(pairs), "rank_id").select(
        "trial", (F.col("sign") * (2 * F.col("auc") - 1)).alias("gini")
    )


# Columns of packed predictions, of the parts of a range (distinct scores and how often they come, as bytes), and of what
# these add up to.
BLOCKS = {"neg": "int", "pos": "int", "rows": "binary", "bad": "bigint"}
PARTS = {"rank_id": "int", "r": "int", "neg": "binary", "neg_n": "binary", "pos": "binary", "pos_n": "binary", "bad": "bigint"}
TOTALS = {"rank_id": "int", "r": "double", "won": "double", "pos": "bigint", "neg": "bigint", "bad": "bigint"}
HISTOGRAMS = {"trial": "int", "size": "int", "counts": "binary", "bad": "bigint"}
BOUNDS = {"trial": "int", "low": "double", "high": "double"}
KINDS = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{n} {k}" for n, k in columns.items())


def _batch(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    found = zip(*rows, strict=True) if rows else [()] * len(columns)
    return pa.record_batch([pa.array(c, KINDS[k]) for c, k in zip(found, columns.values(), strict=True)], list(columns))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row after the other, so a batch of long ones is not held twice."""
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


# -- bounds of the AUC --------------------------------------------------------

# Cells of a trial, and trials at once, in the rounds of bounding: what is left open by a round
# is bounded more closely by the next.
ROUNDS = ((1 << 15, 256), (1 << 18, 32))
EXACT_AT_ONCE = 8
COUNTED_AT_ONCE = 1 << 30  # rows a histogram of 32 bits can hold


def trial_ends(sample: list[np.ndarray], weights: Weights, cells: int) -> tuple[float, float, float]:
    """Lowest and highest score that cells of equal width are laid between, and cells per unit of score."""
    scores = finite_scores([v[:ENDS_ROWS] for v in sample], weights)
    at = [len(scores) // 1000, len(scores) - 1 - len(scores) // 1000]
    low, high = np.partition(scores, at)[at] if len(scores) else (0.0, 0.0)
    with np.errstate(all="ignore"):
        width = np.float64(high - low) / (cells - 1)
        scale = 1 / width
    return (float(low), float(high), float(scale)) if 0 < scale < np.inf else (0.0, 0.0, 0.0)


def gini_bounds(
    df: DataFrame | Packed, target: str, models: list[str], trials: list[Weights], sample: list[np.ndarray], cells: int = ROUNDS[0][0]
) -> DataFrame:
    """(trial, low, high): a true lower and upper bound of every trial's Gini, in one aggregation.

    Each task fills two histograms a trial, of the positive and the negative rows, whose sizes
    do not depend on the rows; the histograms are added up trial by trial as they arrive. Finding
    the cell of a score keeps the order of scores, so pairs in different cells are decided; those
    within a cell are all lost, or all won. Null where a class is missing or a row has no score or no target.
    """
    # A small table is all in the sample.
    cells = min(cells, max(1024, 4 * len(sample[0])))
    ends = [trial_ends(sample, w, cells) for w in trials]

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bad, n = np.zeros((len(trials), 2 * cells), np.int32), [0] * len(trials), 0
        for chunk in _chunks(batches, len(models)):
            places = np.empty(chunk.n, np.int64)
            for j, (w, (low, high, scale)) in enumerate(zip(trials, ends, strict=True)):
                scores, lost = chunk.scores(w)
                np.clip(scores, low, high, out=scores)
                scores -= low
                scores *= scale
                np.copyto(places, scores, casting="unsafe")
                places[chunk.neg :] += cells
                np.add(held[j], np.bincount(places, minlength=2 * cells), out=held[j], casting="unsafe")
                bad[j] += lost
            n += chunk.n
            if n >= COUNTED_AT_ONCE:
                yield from emitted(held, bad)
                held[:], bad, n = 0, [0] * len(trials), 0
        yield from emitted(held, bad)

    def emitted(held: np.ndarray, bad: list[int]) -> Iterator[pa.RecordBatch]:
        for j, counts in enumerate(held):
            small = counts.astype(np.min_scalar_type(counts.max()))
            yield _batch([(j, small.itemsize, small.tobytes(), bad[j])], HISTOGRAMS)

    def bound(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        lost: dict[int, int] = {}
        for row in (r for batch in batches for r in _rows(batch)):
            trial, counts = row["trial"], np.frombuffer(row["counts"], f"u{row['size']}").reshape(2, -1)
            held[trial] = held[trial] + counts if trial in held else counts.astype(np.int64)
            lost[trial] = lost.get(trial, 0) + row["bad"]
        rows = []
        for trial, counts in held.items():
            low = high = None
            # Products of counts may pass 64 bits; sums of doubles are off by far less than `ROUNDING`.
            neg, pos = counts.astype(float)
            pairs = pos.sum() * neg.sum()
            if pairs and not lost[trial]:
                sure, open_ = pos @ (np.cumsum(neg) - neg), pos @ neg
                low, high = float(2 * sure / pairs - 1), float(2 * (sure + open_) / pairs - 1)
            rows.append((trial, low, high))
        yield _batch(rows, BOUNDS)

    # Of more partitions each would send its own histograms.
    rows = _spread(packed(df, target, models).blocks)
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    filled = rows.coalesce(tasks).mapInArrow(fill, _ddl(HISTOGRAMS))
    return filled.repartition(tasks, "trial").mapInArrow(bound, _ddl(BOUNDS))


# Bounds and exact scores come from different sums of the same counts.
ROUNDING = 1e-9


def gini_of_promising(
    df: DataFrame, target: str, models: list[str], trials: list[Weights], sample: list[np.ndarray], best: float | None,
    sign: float = 1.0,
) -> DataFrame:
    """(trial, gini) of the trials that can beat all before them and `best`; no other can be a gain."""
    bounds = {r.trial: (r.low, r.high) for r in gini_bounds(df, target, models, trials, sample).collect()}
    reached, open_ = -np.inf if best is None else sign * best, []
    for i in range(len(trials)):
        low, high = bounds.get(i, (None, None))
        if low is None:
            continue
        low, high = (low, high) if sign > 0 else (-high, -low)
        if high >= reached - ROUNDING:
            open_.append(i)
        reached = max(reached, low)
    if not open_:
        return df.sparkSession.createDataFrame([], "trial int, gini double")
    found = gini_of_weights(df, target, models, [trials[i] for i in open_], sample)
    return found.select(F.array(*[F.lit(i) for i in open_])[F.col("trial")].alias("trial"), "gini")


def _open(bounds: dict[int, tuple[float, float]], reached: float) -> dict[int, tuple[float, float]]:
    """The trials that may have the largest Gini, where it is above `reached`."""
    reached = max([reached, *(low for low, _ in bounds.values())])
    return {i: b for i, b in bounds.items() if b[1] >= reached - ROUNDING}


def largest_ginis(
    df: DataFrame | Packed, target: str, models: list[str], trials: list[Weights], bounds: dict[int, tuple[float, float]],
    sample: list[np.ndarray], best: float | None, sign: float = 1.0,
) -> dict[int, float]:
    """The Gini of the trials of `bounds` (those of `first_bounds`) that can be the best of them and beat `best`; no other can be it.

    Of a large table this leaves a few trials to be ranked, however close all of them are.
    """
    reached = -np.inf if best is None else sign * best
    left = _open(bounds, reached)
    for cells, at_once in ROUNDS[1:]:
        # The most promising first: what they prove leaves less to the others.
        order, closer = sorted(left, key=lambda i: -left[i][1]), {}
        while len(order) + len(closer) > 1 and order:
            part, order = order[:at_once], order[at_once:]
            closer |= _signed_bounds(df, target, models, trials, part, sample, cells, sign)
            still = _open(closer | {i: left[i] for i in order}, reached)
            order = [i for i in order if i in still]
        left = _open(closer | {i: left[i] for i in order}, reached)
    order, found = sorted(left, key=lambda i: -left[i][1]), {}
    while order:
        part, order = order[:EXACT_AT_ONCE], order[EXACT_AT_ONCE:]
        ranked = gini_of_weights(df, target, models, [trials[i] for i in part], sample).collect()
        found |= {part[r.trial]: r.gini for r in ranked if r.gini is not None}
        reached = max([reached, *(sign * g for g in found.values())])
        order = [i for i in order if left[i][1] >= reached - ROUNDING]
    return found


def _signed_bounds(
    df: DataFrame | Packed, target: str, models: list[str], trials: list[Weights], places: list[int], sample: list[np.ndarray], cells: int,
    sign: float,
) -> dict[int, tuple[float, float]]:
    """Bounds of `sign` times the Gini of the trials at `places`; those that cannot be scored are left out."""
    rows = gini_bounds(df, target, models, [trials[i] for i in places], sample, cells).collect()
    known = {places[r.trial]: (r.low, r.high) for r in rows if r.low is not None}
    return {i: b if sign > 0 else (-b[1], -b[0]) for i, b in known.items()}


def first_bounds(
    df: Packed, target: str, models: list[str], trials: list[Weights], sample: list[np.ndarray], sign: float = 1.0
) -> dict[int, tuple[float, float]]:
    """Per trial the bounds of the first round."""
    cells, at_once = ROUNDS[0]
    works = [
        partial(_signed_bounds, df, target, models, trials, [*range(len(trials))[start : start + at_once]], sample, cells, sign)
        for start in range(0, len(trials), at_once)
    ]
    return {i: b for found in side_by_side(df.blocks.sparkSession, works, 2) for i, b in found.items()}


# -- regression ---------------------------------------------------------------


def mape_of_weights(df: DataFrame, target: str, models: list[str], trials: list[Weights]) -> DataFrame:
    """(trial, mape) of the weighted sum for every weight vector, in one aggregation."""
    y = col(target).cast("double")
    floor = F.greatest(F.abs(y), F.lit(EPSILON))
    errors = [F.avg(F.abs(y - weighted_sum(models, w)) / floor).alias(f"e{i}") for i, w in enumerate(trials)]
    entries = [F.struct(F.lit(i).alias("trial"), F.col(f"e{i}").alias("mape")) for i in range(len(trials))]
    return df.agg(*errors).select(F.inline(F.array(*entries)))


@dataclass(frozen=True)
class Search:
    weights: Weights
    score: float
    n_trials: int


def search_weights(
    df: DataFrame,
    target: str,
    models: list[str],
    task: str = "binary_classification",
    direction: str | None = None,
    patience: int = PATIENCE,
    max_trials: int | None = None,
    batch: int = 256,
    seed: int = 42,
    evaluate: Evaluate | None = None,
) -> Search:
    """Best weights on a validation table; `df` is read a few times, so it should be a written one where its plan is costly.

    Classification tries the whole grid first, then draws, and scores by Gini; regression
    only draws and scores by percentage error; `evaluate` scores otherwise. Trials are looked
    at one after the other until `patience` trials bring no gain; they run in batches. For the
    Gini the predictions are packed once, all trials that are looked at in any case are bounded by histograms,
    closer ones for what these leave open, and only trials that may be the best are ranked; those left out could
    not have been the last gain.
    """
    classify = task == "binary_classification"
    direction = direction or ("maximize" if classify else "minimize")
    sign = 1.0 if direction == "maximize" else -1.0
    source, tail = iter(grid(len(models)) if classify else []), draws(len(models), seed)
    bounded = classify and evaluate is None
    if bounded:
        sample, df = edge_rows(df, models), Packed(cut(packed(df, target, models).blocks, "packed"))
    best, best_score, best_at, done = None, None, 0, 0
    while best is None or done - best_at <= patience:
        room = batch
        if bounded:
            # Whatever they gain, so many trials are looked at.
            room = min(batch - done, patience + 1) if best is None else best_at + patience + 1 - done
        room = room if max_trials is None else min(room, max_trials - done)
        trials = list(islice(source, room))
        trials += list(islice(tail, room - len(trials)))
        if not trials:
            break
        if bounded:
            bounds = first_bounds(df, target, models, trials, sample, sign)
            # The first of the largest Ginis among them is the last gain.
            for i, value in sorted(largest_ginis(df, target, models, trials, bounds, sample, best_score, sign).items()):
                if best is None or sign * value > sign * best_score:
                    best, best_score, best_at = trials[i], value, done + i
            done += len(trials)
        else:
            table = (evaluate or mape_of_weights)(df, target, models, trials)
            values = dict(tuple(r) for r in table.collect())
            for i, weights in enumerate(trials):
                if best is not None and done - best_at > patience:
                    break
                value = values.get(i)
                if value is not None and (best is None or sign * value > sign * best_score):
                    best, best_score, best_at = weights, value, done
                done += 1
        if best is None and (not bounded or done in (batch, max_trials)):
            raise ValueError("no trial could be scored: a class is missing")
    return Search(best, best_score, done)
