"""The preprocessing job: source tables to one wide table, split into sets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.functions.values import col, is_numeric
from martloom.operators.combine import merge_features
from martloom.operators.filters import align
from martloom.operators.narrowing import model_cast
from martloom.operators.splits import group_split
from martloom.plans.chain import Chain
from martloom.plans.steps import IGNORE, KEY, step1
from martloom.session import side_by_side
from martloom.sources.tables import CATALOGUE, materialise, read_parts, table_paths, write_stage

WEEK = "WEEK_NUM"
TARGET = "target"


def feature_columns(df: DataFrame, ignore: tuple[str, ...] = IGNORE, drop_first: bool = False) -> list[str]:
    """Every column that is not bookkeeping; `drop_first` leaves out the first of them."""
    names = [c for c in df.columns if c not in ignore]
    return names[1:] if drop_first else names


def parts_of(df: DataFrame, key: str = KEY, week: str = WEEK, target: str = TARGET) -> dict[str, DataFrame]:
    """The id, group, feature and target projections of a table."""
    return {
        "id": df.select(col(key)),
        "group": df.select(col(week)),
        "features": df.select(*[col(c) for c in feature_columns(df)]),
        "target": df.select(col(target)),
    }


def assemble(
    df: DataFrame, features: list[str], keep: tuple[str, ...], output: str = "features", narrow: bool = False
) -> DataFrame:
    """Kept columns and one feature vector; missing values stay as NaN.

    `narrow` rounds the features to single precision, as the stored matrices hold them.
    """
    df = model_cast(df, features) if narrow else df
    vector = VectorAssembler(inputCols=features, outputCol=output, handleInvalid="keep")
    return vector.transform(df).select(*[col(c) for c in keep], output)


def process_tables(
    spark: SparkSession, paths: dict[str, str], out: str, chain: Chain | None = None, per_file: bool = False
) -> dict[str, str]:
    """Run the step-1 chain on each table that has no committed output yet, several tables at once."""
    chain = chain or step1()
    targets = {name: f"{out.rstrip('/')}/{name}" for name in paths}

    def process(name: str) -> None:
        materialise(spark, targets[name], lambda: read_parts(spark, paths[name], chain, per_file))

    side_by_side(spark, [partial(process, name) for name in paths])
    return targets


def merge_tables(spark: SparkSession, targets: dict[str, str], key: str = KEY) -> DataFrame:
    """Left-join the processed tables to the first one whose name holds "base"."""
    base = next(n for n in targets if "base" in n)
    others = [spark.read.parquet(p) for n, p in targets.items() if n != base]
    empty = [t.isEmpty() for t in others]
    return merge_features(spark.read.parquet(targets[base]), others, key, empty)


def numeric_features(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """`df` with flags as numbers, null staying null; a feature of any other kind is an error."""
    kinds = {c: df.schema[c].dataType for c in names}
    flags = [c for c, t in kinds.items() if isinstance(t, T.BooleanType)]
    other = [c for c, t in kinds.items() if c not in flags and not is_numeric(t)]
    if other:
        raise ValueError(f"features that are neither numbers nor flags: {other}")
    return df.withColumns({c: col(c).cast("float") for c in flags}), names


@dataclass(frozen=True)
class MartResult:
    train: DataFrame
    test: DataFrame | None
    shapes: DataFrame


def build_mart(
    spark: SparkSession,
    root: str,
    out: str,
    tables: tuple[str, ...] = CATALOGUE,
    key: str = KEY,
    seed: int = 1,
    with_test: bool = True,
) -> MartResult:
    """The whole job: process, merge, split 60/20/20 by key, write features by set.

    A test split, where there is one, is processed beside the training tables and aligned to
    their columns.
    """
    splits = ("train", "test") if with_test else ("train",)
    works = [partial(process_tables, spark, table_paths(root, s, tables), f"{out}/{s}") for s in splits]
    targets = dict(zip(splits, side_by_side(spark, works)))
    train = merge_tables(spark, targets["train"], key)
    train, features = numeric_features(train, feature_columns(train))
    sets = group_split(train, key, seed)
    vectors = assemble(sets, features, (key, WEEK, TARGET, "split"), narrow=True)
    vectors = vectors.withColumn(TARGET, F.col(TARGET).cast("short"))
    shapes = write_stage(vectors, f"{out}/features", "preprocess", "features", ("split",))
    test = None
    if with_test:
        test = merge_tables(spark, targets["test"], key)
        test = align(test, train.columns, {f.name: f.dataType for f in train.schema.fields})
    return MartResult(spark.read.parquet(f"{out}/features"), test, shapes)
