"""Sources, the source catalogue, multi-part scans, snapshots and stage hand-off."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession

from martloom.functions.values import col
from martloom.operators.combine import union_relaxed
from martloom.operators.filters import nan_to_null
from martloom.sources.contract import Contract

Reader = Callable[..., DataFrame]


def file_reader(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    return spark.read.format(format).options(**options).load(path)


@dataclass(frozen=True)
class Source:
    """A named table: reader with parameters, projection, casts and contract.

    A cast is any Column -> Column function, a pandas UDF included. NaN is read as null.
    """

    name: str
    reader: Reader = file_reader
    params: dict = field(default_factory=dict)
    contract: Contract | None = None
    columns: tuple[str, ...] | None = None
    casts: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        df = self.reader(spark, **self.params)
        if self.columns:
            df = df.select(*[col(c) for c in self.columns])
        if self.casts:
            df = df.withColumns({c: cast(col(c)) for c, cast in self.casts.items()})
        return nan_to_null(df)


def snapshot(df: DataFrame, path: str | None, name: str) -> str | None:
    """Gzip Parquet under the table's name; nothing without a target path."""
    if not path:
        return None
    target = f"{path.rstrip('/')}/{name}"
    df.write.mode("overwrite").option("compression", "gzip").parquet(target)
    return target


def ingest(spark: SparkSession, sources: list[Source], path: str | None = None) -> dict[str, DataFrame]:
    """Read, validate and snapshot each source.

    Later work reads the snapshot where there is one. The validation reads only the
    columns of the contract, so the input is not held in memory between the two passes.
    """
    out = {}
    for s in sources:
        df = s.read(spark)
        if s.contract:
            s.contract.validate(df)
        target = snapshot(df, path, s.name)
        out[s.name] = spark.read.parquet(target) if target else df
    return out


# The logical tables of a split; `*` stands for the part number.
CATALOGUE = (
    "base",
    "static_cb_0",
    "static_0_*",
    "applprev_1_*",
    "tax_registry_a_1",
    "tax_registry_b_1",
    "tax_registry_c_1",
    "credit_bureau_a_1_*",
    "credit_bureau_b_1",
    "other_1",
    "person_1",
    "deposit_1",
    "debitcard_1",
    "credit_bureau_b_2",
    "credit_bureau_a_2_*",
    "applprev_2",
    "person_2",
)


def table_paths(root: str, split: str, names: tuple[str, ...] = CATALOGUE) -> dict[str, str]:
    """Logical name (without the part pattern) -> path or glob."""
    return {n.split("*")[0].rstrip("_"): f"{root.rstrip('/')}/{split}/{split}_{n}.parquet" for n in names}


# -- Hadoop file system -------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to `path` was committed."""
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def matching_paths(spark: SparkSession, glob: str) -> list[str]:
    fs, p = _fs(spark, glob)
    found = fs.globStatus(p)
    return sorted(s.getPath().toString() for s in found) if found else []


# -- multi-part scans ---------------------------------------------------------


def schema_groups(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """Parts grouped by equal schema, in order of first appearance."""
    with ThreadPoolExecutor(16) as pool:
        schemas = list(pool.map(lambda p: spark.read.parquet(p).schema.json(), paths))
    groups: dict[str, list[str]] = {}
    for path, schema in zip(paths, schemas):
        groups.setdefault(schema, []).append(path)
    return list(groups.values())


def read_parts(
    spark: SparkSession,
    glob: str,
    process: Callable[[DataFrame], DataFrame] | None = None,
    per_file: bool = False,
) -> DataFrame:
    """One table from one path or from the parts a glob matches.

    The parts are united by name with widening and processed once. Where Spark can merge
    the footers by itself that is a single scan; parts with clashing types are read as
    one scan per schema. `per_file=True` processes each part on its own and then unites
    the results, leaving out later parts without rows.
    """
    process = process or (lambda df: df)
    if "*" not in glob:
        return process(spark.read.parquet(glob))
    if per_file:
        first, *rest = [process(spark.read.parquet(p)) for p in matching_paths(spark, glob)]
        return union_relaxed([first, *[r for r in rest if not r.isEmpty()]])
    try:
        return process(spark.read.option("mergeSchema", "true").parquet(glob))
    except (PySparkException, Py4JJavaError) as e:
        if "CANNOT_MERGE_SCHEMAS" not in str(e):
            raise
    groups = schema_groups(spark, matching_paths(spark, glob))
    return process(union_relaxed([spark.read.parquet(*g) for g in groups]))


def materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame], format: str = "parquet") -> DataFrame:
    """The table at `path`, built and written only where no committed write is there.

    A folder without the commit marker is what a lost job left behind; it is overwritten.
    """
    if not is_written(spark, path):
        writer = build().write.mode("overwrite").format(format)
        (writer.option("header", "true") if format == "csv" else writer).save(path)
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", "true").option("inferSchema", "true")
    return reader.load(path)


def write_stage(df: DataFrame, path: str, stage: str, table: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a stage's table; returns its shape row (stage, table, n_rows, n_cols).

    The count reads no column, only the row counts in the written files' footers.
    """
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    row = [(stage, table, df.sparkSession.read.parquet(path).count(), len(df.columns))]
    return df.sparkSession.createDataFrame(row, "stage string, `table` string, n_rows bigint, n_cols int")
