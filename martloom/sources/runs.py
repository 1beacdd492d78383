"""Metric files, the run log and the run report."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.functions.reports import TIME_FORMAT, elapsed_text, job_id, local_time, parse_metrics, start_time
from martloom.functions.values import col
from martloom.operators.combine import join_report

# Fixed value: where a run keeps its metrics, below the run's own folder.
METRICS_PATH = r"([^/]+)/model_\d+/metrics[^/]*$"


def metrics_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, metric, value) from one JSON text per row; broken texts give no rows."""
    return df.select(col(key), F.explode(parse_metrics(col(text))).alias("metric", "value"))


def read_metrics(spark: SparkSession, glob: str, pattern: str = METRICS_PATH) -> DataFrame:
    """(job_id, metric, value) from the metric files below `glob`.

    The first group of `pattern` in a file's path is the run; its first file by path counts.
    """
    files = spark.read.option("wholetext", "true").text(glob).withColumn("path", F.input_file_name())
    found = files.withColumn("job_id", F.regexp_extract("path", pattern, 1)).where("job_id <> ''")
    first = found.groupBy("job_id").agg(F.min_by("value", "path").alias("value"))
    return metrics_rows(first, "job_id", "value")


# -- run log ------------------------------------------------------------------


def append_runs(runs: DataFrame, path: str) -> None:
    """Append run rows: start_time, params, and one column per `metrics.` name."""
    runs.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


@dataclass(frozen=True)
class RunLog:
    """Runs of named experiments, each with the moment it began, in a folder of Parquet files.

    Runs are only ever added; files of different experiments may have different metrics.
    """

    spark: SparkSession
    path: str

    def now(self) -> datetime.datetime:
        return self.spark.sql("select current_timestamp()").first()[0]

    def append(self, experiment: str, runs: DataFrame) -> None:
        """Add `runs`; those without a `start_time` begin now."""
        began = col("start_time") if "start_time" in runs.columns else F.current_timestamp()
        append_runs(runs.withColumns({"start_time": began, "experiment": F.lit(experiment)}), self.path)

    def scores(self, experiment: str, moment: datetime.datetime | None = None, keep: tuple[str, ...] = ("model",)) -> DataFrame:
        """What the runs of an experiment, begun at `moment` or later, have measured."""
        runs = read_runs(self.spark, self.path).where(col("experiment") == experiment)
        if moment is not None:
            runs = runs.where(col("start_time") >= F.lit(moment))
        return metric_columns(runs, keep)


def metric_columns(runs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    metrics = [c for c in runs.columns if c.startswith("metrics.")]
    return runs.select(*[col(c) for c in keep], *[col(c).alias(c.rsplit(".", 1)[-1]) for c in metrics])


def runs_after(runs: DataFrame, moment: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metric columns, without their prefix, of the runs started after `moment`."""
    return metric_columns(runs.where(F.col("start_time") > moment), keep)


# -- run report ---------------------------------------------------------------


def run_report(
    runs: DataFrame, metrics: DataFrame, names: list[str], now: Column, resource: str = "resource", status: str = "status"
) -> DataFrame:
    """One row per run: id, status, local start and report time, elapsed text, metrics."""
    wide = (
        metrics.where(F.col("metric").isin(*names))
        .groupBy("job_id")
        .pivot("metric", names)
        .agg(F.round(F.max("value"), 3))
    )
    began = start_time(F.col("job_id"))
    base = runs.select(job_id(col(resource)).alias("job_id"), col(status).alias("status")).select(
        "job_id",
        "status",
        F.date_format(local_time(began), TIME_FORMAT).alias("start_time"),
        F.date_format(local_time(now), TIME_FORMAT).alias("current_time"),
        elapsed_text(now, began).alias("elapsed_time"),
    )
    return join_report(base, wide, "job_id")
