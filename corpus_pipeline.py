"""From raw documents to packed training sequences, in five stages.

Language identification drops what it rejects, lines found in an earlier document go, one
document of each near-duplicate group stays, personal data is redacted, and the rest is
packed into sequences. Each stage works on all its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martloom.llm import stages
from martloom.llm.frames import table
from martloom.session import cut

STAGES = [
    ("language", stages.known_language),
    ("lines", stages.without_repeated_lines),
    ("near_duplicates", stages.without_near_duplicates),
    ("personal_data", stages.without_personal_data),
    ("packing", stages.packed_sequences),
]

# Language identification and packing are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
