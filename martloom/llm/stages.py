"""The pipeline's stages: table in, table out, with the columns of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm import pii
from martloom.llm.frames import unpacked, with_length
from martloom.llm.language import identify
from martloom.llm.line_dedup import drop_repeated_lines
from martloom.llm.near_dedup import drop_near_duplicates
from martloom.llm.packing import pack


# Whole rows go through Python workers that live on from stage to stage, so batches are kept small.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22)


def prepare(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session has a bound of its own, and free the driver.

    A stage leaves plans, compiled classes and job records on the driver. Its JVM gives them back to
    the system only in a full collection, which Spark's own cleaner asks for every half an hour.
    """
    key, size = BATCH_BYTES
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(size))
    spark._jvm.System.gc()


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that language identification rejects."""
    prepare(spark)
    found = identify(docs).where("not rejected")
    kinds = {f.name: f.dataType for f in docs.schema}
    return unpacked(found, docs.columns).select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in docs.columns])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that an earlier document holds too; emptied documents stay, as the next stages decide."""
    prepare(spark)
    return with_length(drop_repeated_lines(docs).select(*docs.columns))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepare(spark)
    return drop_near_duplicates(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span replaced by its kind."""
    prepare(spark)
    return with_length(pii.redact(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    prepare(spark)
    return pack(docs)
