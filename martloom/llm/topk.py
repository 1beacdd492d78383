"""Exact top-k inner products from an impact-ordered index, score at a time.

Components are integers. A shard of the index holds a bounded number of vectors as posting
segments: one segment per impact class, the entries whose size lies between two powers of
two, and for every vector the norm of what the later segments still hold. A block of queries
goes through the segments of a shard by descending impact. After each, a score so far is off
by at most the query's norm times the vector's rest norm; vectors that cannot reach the k-th
best lower bound are out, and a query stops only when that bound leaves few vectors, or
when no segment is left. The vectors still possible are scored again exactly. A shard gives
its best `k` per query, and a window with a group limit merges the shards.

Query blocks meet shards by an equi-join on the shard number: blocks are copied to every
shard, which is what a search over all rows needs, but no task holds more than one block and
one shard.

Defined results: vectors that are null, or hold null or non-finite components, and rows
without an id take no part; missing trailing components count as zero; rows that repeat an
id are one vector (the smallest); a query's candidates are all other ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.frames import column, map_stream
from martloom.session import cut

SCALE = 64
# Vectors in a shard and queries in a block.
SHARD_ROWS, BLOCK_ROWS = 4096, 512
# A query stops early when at most so many times k vectors are still possible.
FEW = 4


def scaled(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, values): one row per id, components as floor(scale * x)."""
    vector = column(df, vector_col)
    fit = vector.isNotNull() & F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    )
    values = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    rows = df.where(fit & column(df, id_col).isNotNull())
    rows = rows.select(column(rows, id_col).cast("bigint").alias("id"), values.alias("values"))
    return rows.groupBy("id").agg(F.min("values").alias("values"))


def blocked(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """(name, ids, rows): about `size` rows of (id, values) packed into one, and how many such."""
    number = max(1, math.ceil(rows.count() / size))
    at = F.pmod(F.xxhash64("id"), F.lit(number)).cast("int").alias(name)
    grouped = rows.groupBy(at).agg(F.sort_array(F.collect_list(F.struct("id", "values"))).alias("rows"))
    return grouped.select(name, F.col("rows.id").alias("ids"), F.col("rows.values").alias("rows")), number


def matrix(rows: pa.ListScalar) -> np.ndarray:
    """Vectors of one block, short ones filled up with zeros."""
    lists = rows.values
    ends = np.asarray(lists.offsets)
    lengths = np.diff(ends)
    flat = np.asarray(lists.flatten())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def segments(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By descending impact: the entries of each class, and the norm of each vector's later entries."""
    size = np.abs(vectors.astype(np.float64))
    out, top = [], int(size.max(initial=0)).bit_length()
    for bit in range(top, 0, -1):
        inside = (size >= 2.0 ** (bit - 1)) & (size < 2.0**bit)
        if inside.any():
            rest = np.where(size < 2.0 ** (bit - 1), size, 0)
            out.append((np.where(inside, vectors, 0), np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9)))
    return out


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right.T of integers, exactly, in the fastest type that holds all sums."""
    bound = float(np.abs(left.astype(np.float64)).max(initial=0)) * float(np.abs(right.astype(np.float64)).max(initial=0))
    bound *= max(1, left.shape[1])
    if bound < 2**24:
        return (left.astype(np.float32) @ right.T.astype(np.float32)).astype(np.float64)
    if bound < 2**52:
        return left.astype(np.float64) @ right.T.astype(np.float64)
    exact = left.astype(object) @ right.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1)


def best_of(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, index: list, k: int
) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vector ids, scores): the best `k` of one shard for each query of a block."""
    large = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(vectors.astype(np.float64)).max(initial=0))
    if large * max(1, queries.shape[1]) >= 2**52:
        # Bounds in floating point prove nothing for numbers of this size.
        open_rows, possible = np.arange(len(queries)), np.ones((len(queries), len(vectors)), dtype=bool)
    else:
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        score = np.zeros((len(queries), len(vectors)))
        possible = np.ones(score.shape, dtype=bool)
        own = query_ids[:, None] == ids[None, :]
        open_rows = np.arange(len(queries))
        for entries, rest in index:
            score[open_rows] += product(queries[open_rows], entries)
            off = norms[open_rows, None] * rest[None, :]
            low = np.where(own[open_rows], -np.inf, score[open_rows] - off)
            if low.shape[1] > k:
                least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
                possible[open_rows] &= score[open_rows] + off >= least[:, None]
            open_rows = open_rows[possible[open_rows].sum(axis=1) > FEW * k]
            if not len(open_rows):
                break
    for i in range(len(queries)):
        members = np.flatnonzero(possible[i] & (ids != query_ids[i]))
        exact = product(queries[i : i + 1], vectors[members])[0]
        order = np.lexsort((ids[members], -exact))[:k]
        yield int(query_ids[i]), ids[members][order], exact[order]


def search(
    df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, id_col, score): each query's best `k` other rows; `is_query` is over `id`."""
    rows = cut(scaled(df, id_col, vector_col, scale), "vectors")
    shards, number = blocked(rows, SHARD_ROWS, "shard")
    blocks, _ = blocked(rows.where(is_query), BLOCK_ROWS, "block")
    copies = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("shard"),
        F.col("ids").alias("query_ids"), F.col("rows").alias("queries"),
    )
    met = copies.join(shards, "shard")

    def score(parts: Iterable[pa.RecordBatch]) -> Iterable[dict]:
        last, vectors, index = None, None, []
        for batch in parts:
            for r in range(batch.num_rows):
                ids, query_ids = (np.asarray(batch.column(c)[r].values) for c in ("ids", "query_ids"))
                if last != batch.column("shard")[r].as_py():
                    last, vectors = batch.column("shard")[r].as_py(), matrix(batch.column("rows")[r])
                    index = segments(vectors)
                queries = matrix(batch.column("queries")[r])
                width = max(queries.shape[1], vectors.shape[1])
                if vectors.shape[1] < width:
                    vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
                    index = segments(vectors)
                queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
                found = list(best_of(queries, query_ids, vectors, ids, index, k))
                yield {
                    "query_id": np.repeat([q for q, _, _ in found], [len(m) for _, m, _ in found]),
                    "id": np.concatenate([m for _, m, _ in found]),
                    "score": np.concatenate([s for _, _, s in found]).astype(np.int64),
                }

    found = map_stream(met, "query_id bigint, id bigint, score bigint", score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
