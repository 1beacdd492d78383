"""Token counts kept up to date by signed deltas.

A rollup is a folder with three tables, each partitioned by batch: the ledger holds signed
rows per document (an insert adds its counts, a delete takes back what the ledger says of
the document, a revision does both), the totals hold the sums of a batch's ledger rows by
source, language and tokenizer version, and the commits name the batches that count. A
commit is written last, and every reader looks at committed batches only, so a batch that
was cut off leaves nothing behind: it is written again in the same place. Committing a batch
a second time changes nothing. Totals are additive, so they are summed over batches without
another look at documents.

Defined results: within a batch the change with the greatest `seq` of a document counts;
an insert of a known document is a revision, a delete of an unknown one does nothing; null
sources and languages are groups of their own; a change without an id is counted on insert
and can be neither revised nor deleted; a null text has no tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martloom.llm.frames import column, map_stream, slices

KEYS = ["source", "lang", "version"]
LEDGER = "doc_id bigint, source string, lang string, version string, docs bigint, tokens bigint"


def words(texts: list[bytes]) -> list[int]:
    """Number of words between ASCII white space."""
    return [len(t.split()) for t in texts]


@lru_cache(maxsize=4)
def _byte_pairs(path: str) -> object:
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_pairs(path: str) -> Callable[[list[bytes]], list[int]]:
    """A counter of the ids that a file of ranks gives."""

    def count(texts: list[bytes]) -> list[int]:
        encoding = _byte_pairs(path)
        return [len(encoding.encode_ordinary(t.decode("utf-8", "replace"))) for t in texts]

    return count


def default_versions() -> dict[str, Callable[[list[bytes]], list[int]]]:
    import public_tokenizers

    return {"byte_bpe_50k": byte_pairs(public_tokenizers.path("byte_bpe_50k.tiktoken")), "words": words}


def counted(
    changes: DataFrame, versions: dict[str, Callable[[list[bytes]], list[int]]], id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """(op, seq, doc_id, source, lang, version, tokens): a row of each change for each version.

    `changes` has the columns named, `op` (insert, revise or delete) and `seq`.
    """
    rows = changes.select(
        F.col("op"), F.col("seq").cast("bigint").alias("seq"), column(changes, id_col).cast("bigint").alias("doc_id"),
        column(changes, source_col).cast("string").alias("source"), column(changes, lang_col).cast("string").alias("lang"),
        column(changes, text_col).cast("binary").alias("text"),
    )
    names = list(versions)

    def count(parts: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(parts, "text", 1 << 22):
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for name in names:
                own = {c: batch.column(c) for c in ("op", "seq", "doc_id", "source", "lang")}
                yield own | {"version": [name] * len(texts), "tokens": versions[name](texts)}

    schema = "op string, seq bigint, doc_id bigint, source string, lang string, version string, tokens bigint"
    return map_stream(rows, schema, count)


class TokenRollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def batches(self) -> list[str]:
        """Committed batches; one name each, written by the driver."""
        try:
            rows = self.spark.read.schema("batch string").parquet(f"{self.root}/commits/*").distinct().collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r["batch"] for r in rows)

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{table}/batch={b}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches."""
        rows = self._read("totals", "source string, lang string, version string, docs bigint, tokens bigint")
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Take in the counted changes of a batch; False when it was committed before.

        Batches are committed one at a time, and their names are fit for a path.
        """
        if batch in self.batches():
            return False
        self._signed(changes).write.mode("overwrite").parquet(f"{self.root}/ledger/batch={batch}")
        own = self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger/batch={batch}")
        deltas = own.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.root}/totals/batch={batch}")
        done = self.spark.createDataFrame([(batch,)], "batch string").coalesce(1)
        done.write.mode("overwrite").parquet(f"{self.root}/commits/{batch}")
        return True

    def _signed(self, changes: DataFrame) -> DataFrame:
        """The ledger rows of a batch."""
        order = Window.partitionBy("doc_id", "version").orderBy(F.desc("seq"), "op", F.desc("tokens"), "source", "lang")
        known = changes.where("doc_id is not null").withColumn("place", F.row_number().over(order))
        last = known.where("place = 1").drop("place")
        added = last.where("op <> 'delete'").unionByName(changes.where("doc_id is null and op = 'insert'"))
        plus = added.select("doc_id", *KEYS, F.lit(1).cast("bigint").alias("docs"), "tokens")
        # A delete needs no count, so it may name a document for one version or for all.
        named = last.select("doc_id").distinct()
        standing = self.ledger().where("doc_id is not null").join(named, "doc_id", "left_semi")
        standing = standing.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        minus = standing.where("docs <> 0 or tokens <> 0").select(
            "doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")
        )
        return plus.unionByName(minus)
