"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its byte n-grams, each hashed into one of
`2 ** BITS` rows; a linear layer gives one logit per language. Training is plain stochastic
gradient descent in numpy on a bounded sample of labelled rows (`SAMPLE` documents in all,
shared evenly by the languages and drawn by a hash of the id). Scoring runs over every text
inside Spark tasks: mean and layer are linear, so they are folded into one table of a logit
per row and language.

A part of the sample is kept out of the descent: it fits the temperature that calibrates the
scores, and the score below which a prediction is rejected: `MARGIN` times the lowest score of
a right prediction there, so that texts of a learned language stay, and at most
`HIGHEST_REJECTION`.

Defined results: a null text or one without a letter is `und` with score 0 and rejected; a
null id counts as the empty text for the split; without any labelled row every text is `und`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from martloom.llm.frames import column, map_stream, packed, slices

BITS = 14
BUCKET = np.uint16  # holds BITS bits
GRAMS = (2, 3, 4)
DIMENSIONS = 16
# Bound on the labelled documents a model is fitted on.
SAMPLE = 2400
CALIBRATION = 0.25
MARGIN = 0.75
HIGHEST_REJECTION = 0.5
UNKNOWN = "und"


class LanguageModel(NamedTuple):
    languages: list[str]
    logits: np.ndarray  # a row per bucket, a column per language
    temperature: float
    least_score: float


def held_out(id_col: Column) -> Column:
    """Rows that no model may learn from."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte."""
    size = max(0, len(data) - n + 1)
    code = np.zeros(size, dtype=np.uint32)
    for i in range(n):
        code = (code << np.uint32(8)) | data[i : i + size]
    code = (code ^ (code >> np.uint32(15)) ^ np.uint32(n * 0x2545F491 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
    return code >> np.uint32(32 - BITS)


def text_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each is met."""
    data = np.frombuffer(text.lower(), dtype=np.uint8)
    return np.unique(np.concatenate([buckets(data, n) for n in GRAMS]), return_counts=True)


def sample_rows(labelled: DataFrame, sample: int) -> DataFrame:
    """About `sample` rows of a table (id, text, lang), as many of each language if it has them.

    The number of languages is taken to be small enough for the driver.
    """
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return labelled.limit(0)
    each = sample / len(counts)
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.where(draw < share)


def fit(labelled: DataFrame, sample: int = SAMPLE, epochs: int = 12, seed: int = 7) -> LanguageModel:
    """A model from a table (id, text, lang); rows without a text, language or letter teach nothing."""
    usable = labelled.where("lang is not null and text is not null").where(F.col("text").cast("string").rlike(r"\p{L}"))

    def features(parts: Iterable[pa.RecordBatch]) -> Iterable[dict]:
        for batch in parts:
            found = [text_counts(t) for t in batch.column("text").to_pylist()]
            yield {
                "id": batch.column("id"), "lang": batch.column("lang"),
                "bucket": [b.astype(BUCKET).tobytes() for b, _ in found], "n": [c.astype(np.uint32).tobytes() for _, c in found],
            }

    schema = "id bigint, lang string, bucket binary, n binary"
    rows = map_stream(sample_rows(usable, sample).select("id", "text", "lang"), schema, features)

    def learn(parts: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(parts))
        order = pc.sort_indices(rows, [("id", "ascending"), ("lang", "ascending")]).to_pylist()
        counts = [
            (np.frombuffer(rows["bucket"][i].as_buffer(), BUCKET), np.frombuffer(rows["n"][i].as_buffer(), np.uint32)) for i in order
        ]
        made = train(counts, [rows["lang"][i].as_py() for i in order], epochs, seed)
        logits = np.ascontiguousarray(made.logits)
        yield pa.RecordBatch.from_pylist([{
            "languages": made.languages, "logits": logits.tobytes(), "kind": logits.dtype.str,
            "temperature": float(made.temperature), "least": float(made.least_score),
        }])

    # The sample is bounded, so one task holds it: the driver gets the model alone.
    kinds = "languages array<string>, logits binary, kind string, temperature double, least double"
    found = rows.repartition(1).mapInArrow(_with_rows(learn), kinds).collect()
    if not found:
        return train([], [], epochs, seed)
    made = found[0]
    logits = np.frombuffer(made.logits, made.kind).reshape(1 << BITS, len(made.languages))
    return LanguageModel(list(made.languages), logits, made.temperature, made.least)


def _with_rows(function: Callable) -> Callable:
    """`function` of the batches with rows, where there are any."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = [batch for batch in parts if batch.num_rows]
        if held:
            yield from function(held)

    return run


def train(counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int, seed: int) -> LanguageModel:
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), dtype=np.float32), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    target = np.searchsorted(languages, labels)
    order = rng.permutation(len(labels))
    kept = int(len(order) * CALIBRATION)
    checks, learn = order[:kept], order[kept:]
    table = rng.normal(0, 0.01, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.3, (DIMENSIONS, len(languages))).astype(np.float32)

    def mean_of(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
        for i, r in enumerate(rows):
            bucket, n = counts[r]
            if len(bucket):
                x[i, bucket] = n / n.sum()
        return x

    steps, step, batch = epochs * -(-len(learn) // 32), 0, 32
    for _ in range(epochs):
        rng.shuffle(learn)
        for start in range(0, len(learn), batch):
            rows = learn[start : start + batch]
            rate = 1 - step / steps
            x = mean_of(rows)
            hidden = x @ table
            error = softmax(hidden @ layer)
            error[np.arange(len(rows)), target[rows]] -= 1
            error /= len(rows)
            grad = x.T @ (error @ layer.T)
            layer -= 1.0 * rate * (hidden.T @ error)
            table -= 50.0 * rate * grad
            step += 1
    logits = table @ layer
    if not kept:
        return LanguageModel(languages, logits, 1.0, 0.0)
    raw = np.concatenate([mean_of(checks[i : i + 64]) @ logits for i in range(0, kept, 64)])
    truth, at = target[checks], np.arange(kept)
    temperature = min(
        (float(t) for t in np.geomspace(0.05, 5, 40)),
        key=lambda t: -np.log(np.maximum(softmax(raw / t)[at, truth], 1e-12)).mean(),
    )
    scores = softmax(raw / temperature)
    right = np.sort(scores.max(axis=1)[scores.argmax(axis=1) == truth])
    least = MARGIN * right[0] if len(right) else 0.0
    return LanguageModel(languages, logits, temperature, float(min(HIGHEST_REJECTION, least)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def text_logits(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Mean logits of each text. `table` has a row per language."""
    data = np.frombuffer(b"".join(texts).lower(), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    out, total = np.zeros((len(texts), len(table))), np.zeros(len(texts))
    for n in GRAMS:
        at = buckets(data, n)
        last = np.maximum(ends - n + 1, starts)
        total += last - starts
        last, first = np.minimum(last, len(at)), np.minimum(starts, len(at))
        for j, row in enumerate(table):
            sums = np.zeros(len(at) + 1)
            np.cumsum(row[at], out=sums[1:], dtype=np.float64)
            out[:, j] += sums[last] - sums[first]
    return out / np.maximum(total, 1)[:, None]


def predicted(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """A packed table with `lang_pred`, `score` and `rejected`."""
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    table = np.ascontiguousarray(model.logits.T)
    temperature, least, known = model.temperature, model.least_score, bool(model.languages)

    def score(parts: Iterable[pa.RecordBatch]) -> Iterable[dict]:
        for batch in slices(parts, "text", 1 << 20):
            n = batch.num_rows
            letters = np.array(batch.column("letters").to_pylist(), dtype=bool) & known
            label, best = np.full(n, len(names) - 1), np.zeros(n)
            if known:
                p = softmax(text_logits([t or b"" for t in batch.column("text").to_pylist()], table) / temperature)
                label, best = np.where(letters, p.argmax(axis=1), label), np.where(letters, p.max(axis=1), 0.0)
            own = {c: batch.column(c) for c in batch.schema.names if c != "letters"}
            yield own | {"lang_pred": names[label].tolist(), "score": best, "rejected": ~letters | (best < least)}

    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    schema = StructType(list(rows.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return map_stream(rows.withColumn("letters", letters), schema, score)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE
) -> DataFrame:
    """A packed table with predictions, from a model fitted on the rows that are not held out."""
    labelled = docs.select(
        column(docs, id_col).cast("bigint").alias("id"),
        column(docs, text_col).cast("binary").alias("text"),
        column(docs, lang_col).cast("string").alias("lang"),
    ).where(~held_out(F.col("id")))
    return predicted(packed(docs, id_col, text_col), fit(labelled, sample))
