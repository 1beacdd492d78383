"""Line dedup over levelled sorted runs of line hashes.

The index is a set of runs. A run is a table of (line hash, first document) in the shared
folder, bucketed and sorted by the hash, each bucket one file, so a run is never shuffled or
sorted again. A batch is reduced to one row per hash, looked up in every run by merge joins,
and what no run knows becomes a new run. As soon as `fan_in` runs stand on a level they are
merged, bucket by bucket as they lie, into one on the next, so a batch meets few runs however
many came before.

Hashes have 128 bits. Defined results: a null or empty text is one empty line; rows with
a null id keep all their lines and are not counted; rows that repeat an id are one
document, so a line of theirs stays in each of them; a key is dropped from every row of
every document but the first that brought it. Lines whose key is shorter than
`min_chars` code points always stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from martloom.llm.frames import delete_path, map_batches, map_stream, packed, setting, slices, unpacked
from martloom.session import cut, scratch_path

MIN_CHARS = 10
# Lets Spark rely on the order within a bucket of one file.
AS_WRITTEN = ("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Hash of the stripped and lower-cased line, None where it is too short to count.

    `bytes.strip` and `bytes.lower` know ASCII white space and A-Z only.
    """
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, h): the different line hashes of each row of a packed table."""

    def hashes(batch: pa.RecordBatch) -> dict:
        ids, keys = [], []
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = {line_key(line, min_chars) for line in (text or b"").split(b"\n")} - {None}
            ids.extend([i] * len(own))
            keys.extend(own)
        return {"id": ids, "h": keys}

    return map_batches(docs.where("id is not null").select("id", "text"), "id bigint, h binary", hashes)


class LineIndex:
    """The runs seen so far. Batches are told apart by arrival: earlier ones come first."""

    def __init__(self, spark: SparkSession, fan_in: int = 2, buckets: int | None = None) -> None:
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame, level: int) -> None:
        """A new run of `rows`, which lie in one partition per bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, name)
        (
            rows.write.bucketBy(self.buckets, "h")
            .sortBy("h")
            .format("parquet")
            .option("path", self.paths[name])
            .saveAsTable(name)
        )
        self.runs.append((level, name))

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, self.paths.pop(name))

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in one batch of (id, h); the result names the (id, h) that repeat.

        Within the batch the smallest id is the first document of a new line.
        """
        found = lines.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        known = []
        for i, (_, name) in enumerate(self.runs):
            run = self.spark.table(name).select("h", F.col("first").alias(f"first_{i}"))
            found, known = found.join(run, "h", "left"), [*known, F.col(f"first_{i}")]
        seen = F.coalesce(*known, F.lit(None).cast("bigint"))
        with setting(self.spark, *AS_WRITTEN):
            looked = cut(found.select("h", "low", "high", seen.alias("seen")), "lines")
        new = looked.where("seen is null").select("h", F.col("low").alias("first"))
        self._write(new.repartition(self.buckets, "h"), 0)
        self._compact()
        repeated = looked.select("h", F.coalesce("seen", "low").alias("first"), "low", "high").where(
            "low <> first or high <> first"
        )
        return cut(lines.join(repeated.select("h", "first"), "h").where("id <> first").select("id", "h"), "drops")

    def _merged(self, names: list[str]) -> DataFrame:
        """One run's rows from those of several; no hash is in two of them."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("first", "other")
            rows = rows.join(other, "h", "full").select("h", F.least("first", "other").alias("first"))
        return rows

    def _compact(self) -> None:
        level = 0
        while len(full := [name for at, name in self.runs if at == level]) >= self.fan_in:
            with setting(self.spark, *AS_WRITTEN):
                self._write(self._merged(full), level + 1)
            self.runs = [run for run in self.runs if run[1] not in full]
            for name in full:
                self._remove(name)
            level += 1

    def drop(self) -> None:
        """Give up the index and its tables."""
        for _, name in self.runs:
            self._remove(name)
        self.runs = []


def by_id_range(docs: DataFrame, batches: int) -> list[int]:
    """Ids that cut a packed table into batches of about equal row counts, ascending."""
    shares = [i / batches for i in range(1, batches)]
    row = docs.select(F.percentile_approx("id", F.array(*map(F.lit, shares))).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = 4,
    fan_in: int = 2,
) -> DataFrame:
    """`docs` without the lines that a smaller id holds too, and with two counts.

    The table is fed to a `LineIndex` as `batches` batches of ascending ids, as if they
    had arrived one after another. Adds `n_lines` (before dropping) and `n_dropped`.
    """
    rows = packed(docs, id_col, text_col)
    repeated = _repeated(rows, min_chars, batches, fan_in).groupBy("id").agg(F.collect_list("h").alias("gone"))
    joined = rows.join(repeated, "id", "left").select("text", "gone", "row")

    def rebuild(parts: Iterable[pa.RecordBatch]) -> Iterable[dict]:
        for batch in slices(parts, "text", 1 << 24):
            texts, lines, dropped = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                own = (text or b"").split(b"\n")
                if gone:
                    gone = set(gone)
                    kept = [line for line in own if line_key(line, min_chars) not in gone]
                else:
                    kept = own
                texts.append(b"\n".join(kept))
                lines.append(len(own))
                dropped.append(len(own) - len(kept))
            yield {"text": texts, "row": batch.column("row"), "lines": lines, "dropped": dropped}

    schema = StructType([joined.schema["text"], joined.schema["row"]]).add("lines", "long").add("dropped", "long")
    out = map_stream(joined, schema, rebuild)
    return unpacked(
        out, [c for c in docs.columns if c not in ("n_lines", "n_dropped")], text_col,
        F.col("lines").alias("n_lines"), F.col("dropped").alias("n_dropped"),
    )


def _repeated(rows: DataFrame, min_chars: int, batches: int, fan_in: int) -> DataFrame:
    """(id, h) of all lines to drop, batch by batch through the index."""
    cuts = by_id_range(rows, batches)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("id") > c).cast("int")
    lines = cut(line_hashes(rows, min_chars).withColumn("batch", number), "hashes", ("batch",))
    index, out = LineIndex(rows.sparkSession, fan_in), None
    for i in range(len(cuts) + 1):
        found = index.add(lines.where(F.col("batch") == i).select("id", "h"))
        out = found if out is None else out.unionByName(found)
    index.drop()
    return out
