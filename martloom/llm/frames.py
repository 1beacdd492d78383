"""Small helpers the corpus operators share: packed rows, Arrow batches, row order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from martloom.functions.values import quoted
from martloom.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str) -> Column:
    return df[quoted(name)]


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, row): names an operator may rely on, whatever else the table holds.

    `row` keeps every column but the text, so extra columns cannot clash with those an
    operator adds, and the text is carried once.
    """
    rest = [column(docs, c) for c in docs.columns if c != text_col]
    return docs.select(
        column(docs, id_col).cast("bigint").alias("id"),
        column(docs, text_col).cast("binary").alias("text"),
        F.struct(*rest).alias("row"),
    )


def unpacked(df: DataFrame, columns: list[str], text_col: str = "text", *more: Column) -> DataFrame:
    """The original columns in their order, the text as a string, then `more`."""
    own = [
        F.decode("text", "utf-8").alias(c) if c == text_col else F.col(f"row.{quoted(c)}").alias(c) for c in columns
    ]
    return df.select(*own, *more)


def with_length(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """`length_col`, where the table has it, brought up to date with the text."""
    if length_col not in docs.columns:
        return docs
    kind = docs.schema[length_col].dataType
    return docs.withColumn(length_col, F.length(F.coalesce(column(docs, text_col), F.lit(""))).cast(kind))


def map_batches(df: DataFrame, schema: str | StructType, f: Callable[[pa.RecordBatch], dict | None]) -> DataFrame:
    """Run `f` on each Arrow batch; it returns the columns of the result, or None for no rows."""
    return map_stream(df, schema, lambda batches: (f(b) for b in batches if b.num_rows))


def map_stream(
    df: DataFrame, schema: str | StructType, f: Callable[[Iterable[pa.RecordBatch]], Iterable[dict | None]]
) -> DataFrame:
    """Run `f` once a task over all its Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in f(batches):
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [_array(out[field.name], field.type) for field in arrow], schema=arrow
                )

    return df.mapInArrow(run, schema)


class Scratch:
    """Tables in the shared folder, each given up as soon as nothing later reads it."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{name}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def give_up(self, df: DataFrame) -> None:
        path, _ = self.paths.pop(id(df))
        delete_path(self.spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """`key` at `value` for the jobs that run within, then as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def slices(batches: Iterable[pa.RecordBatch], size_of: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the bytes of column `size_of` stay near `limit`, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(size_of)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
