"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from martloom.functions.values import quoted

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.caseSensitive": "true",
}


def get_session(app: str = "martloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def side_by_side(spark: SparkSession, works: list[Callable[[], object]], at_once: int = 4) -> list:
    """The results of independent pieces of work, whose jobs share the cores.

    A stage with fewer tasks than cores, or one slow task, then leaves no core idle.
    """
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda run: inheritable_thread_target(spark)(run)(), works))


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Where it is unset (tests, a laptop) a fresh local folder is set for the session,
    which is only right when driver and executors share one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="martloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that no other call gets, below the application's own part of the shared folder.

    Tables there are of no use once the application has ended and its part may be deleted.
    """
    return f"{scratch_root(spark)}/martloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Later jobs start from the written table, so neither a lost executor nor a second
    action repeats the work before the cut, and scans of it are pruned to the columns
    and partitions they need.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[quoted(c) for c in df.columns])


def written_side(df: DataFrame, name: str = "side") -> DataFrame:
    """`df` as a join side: written, so it is computed once and its size in bytes is known.

    Catalyst broadcasts it below its own limit and shuffles it beyond.
    """
    return cut(df, name)
