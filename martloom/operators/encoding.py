"""Category and date encodings."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from martloom.functions.dates import DATE_FEATURES
from martloom.functions.values import col
from martloom.operators.narrowing import Narrowing, NarrowPlan, is_categorical, number_type
from martloom.operators.plan import DropColumns, Identity, Plan
from martloom.operators.profile import ColumnStats, Distinct, distinct_values
from martloom.session import cut, written_side


@dataclass(frozen=True)
class OneHotPlan:
    """Values per column, ascending; `null_label` names the column for null, last."""

    values: tuple[tuple[str, tuple, bool], ...]
    null_label: str = "null"
    as_boolean: bool = False

    def _flag(self, test: Column, name: str) -> Column:
        if self.as_boolean:
            return test.alias(name)
        return F.when(test, 1).otherwise(0).cast("short").alias(name, metadata={"ref_type": "uint8"})

    def apply(self, df: DataFrame) -> DataFrame:
        encoded = {c for c, _, _ in self.values}
        out = [col(c) for c in df.columns if c not in encoded]
        for c, values, has_null in self.values:
            out += [self._flag(col(c).eqNullSafe(F.lit(v)), f"{c}_{v}") for v in values]
            if has_null:
                out.append(self._flag(col(c).isNull(), f"{c}_{self.null_label}"))
        return df.select(*out)


def fit_one_hot(
    df: DataFrame, columns: list[str], null_label: str = "null", as_boolean: bool = False, limit: int | None = None,
    known: dict[str, Distinct] | None = None,
) -> OneHotPlan:
    """Learn the values of each column that are not `known` yet; with a `limit` more values than that are an error, not a cut.

    A flag column per value needs the values in the plan, and so on the driver; columns of very
    many values belong into `SparseOneHot`.
    """
    if not columns:
        return OneHotPlan((), null_label, as_boolean)
    known = known or {}
    found = known | distinct_values(df, [c for c in columns if c not in known], sys.maxsize if limit is None else limit + 1)
    found = {c: found[c] for c in columns}
    wide = [c for c in columns if found[c].values is None]
    if wide:
        raise ValueError(f"more than {limit} values in {wide}: drop or label-encode these columns")
    names = [c for c in df.columns if c not in columns]
    for c in columns:
        names += [f"{c}_{v}" for v in found[c].values] + [f"{c}_{null_label}"] * (found[c].n_null > 0)
    if df.sparkSession.conf.get("spark.sql.caseSensitive") != "true":
        names = [n.lower() for n in names]
    if len(set(names)) < len(names):
        raise ValueError("one-hot column names clash; rename values or set spark.sql.caseSensitive to true")
    return OneHotPlan(tuple((c, tuple(d.values), d.n_null > 0) for c, d in found.items()), null_label, as_boolean)


@dataclass(frozen=True)
class DatePlan:
    """Date columns to replace by features, and the narrow types of these."""

    columns: tuple[str, ...]
    features: tuple[str, ...]
    types: NarrowPlan = NarrowPlan(())

    def apply(self, df: DataFrame) -> DataFrame:
        keep = [col(c) for c in df.columns if c not in self.columns]
        new = [DATE_FEATURES[k](col(c)).alias(f"{c}_{k}") for c in self.columns for k in self.features]
        return self.types.apply(df.select(*keep, *new))


def fit_dates(df: DataFrame, features: tuple[str, ...] = ("unix",)) -> DatePlan:
    """Replace every date column by `features`, each in its narrowest type."""
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
    if not dates:
        return DatePlan((), features)
    if not features:
        return DatePlan(tuple(dates), ())
    made = [(f"{c}_{k}", DATE_FEATURES[k](col(c))) for c in dates for k in features]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (_, e) in enumerate(made):
        aggs += [F.min(e).alias(f"l{i}"), F.max(e).alias(f"h{i}"), F.count_if(e.isNull()).alias(f"z{i}")]
    row = df.agg(*aggs).first()
    types = []
    for i, (name, _) in enumerate(made):
        s = ColumnStats(name, T.IntegerType(), row["n"], row[f"z{i}"], row[f"l{i}"], row[f"h{i}"])
        types.append(Narrowing(name, *number_type(s)))
    return DatePlan(tuple(dates), features, NarrowPlan(tuple(types)))


@dataclass(frozen=True)
class EncodingPlan:
    one_hot: OneHotPlan
    dates: DatePlan

    def apply(self, df: DataFrame) -> DataFrame:
        return self.dates.apply(self.one_hot.apply(df))


@dataclass(frozen=True)
class Encode:
    """Chain stage: one-hot every categorical column, turn every date into features."""

    features: tuple[str, ...] = ("unix",)
    limit: int | None = None

    def fit(self, df: DataFrame) -> Plan:
        if df.isEmpty():
            return Identity()
        categories = [f.name for f in df.schema.fields if is_categorical(f)]
        return EncodingPlan(fit_one_hot(df, categories, limit=self.limit), fit_dates(df, self.features))


@dataclass(frozen=True)
class EncodeNarrow:
    """Chain stage: `DropHighCardinality` and then `Encode`, which share one look at the values.

    Categorical columns with `threshold` or more values, null being a value, go; those to
    ignore stay and are encoded whatever their width.
    """

    threshold: int = 10
    ignore: tuple[str, ...] = ()
    features: tuple[str, ...] = ("unix",)

    def fit(self, df: DataFrame) -> Plan:
        if df.isEmpty():
            return Identity()
        categories = [f.name for f in df.schema.fields if is_categorical(f)]
        free = [c for c in categories if c not in self.ignore]
        found = distinct_values(df, free, self.threshold)
        wide = tuple(c for c, d in found.items() if d.values is None or len(d.values) + (d.n_null > 0) >= self.threshold)
        drop = DropColumns(wide)
        kept = drop.apply(df)
        known = {c: d for c, d in found.items() if c not in wide}
        one_hot = fit_one_hot(kept, [c for c in categories if c not in wide], known=known)
        return DroppedAndEncoded(drop, EncodingPlan(one_hot, fit_dates(kept, self.features)))


@dataclass(frozen=True)
class DroppedAndEncoded:
    drop: DropColumns
    encode: EncodingPlan

    def apply(self, df: DataFrame) -> DataFrame:
        return self.encode.apply(self.drop.apply(df))


@dataclass(frozen=True)
class OneHotBoolean:
    """Chain stage: every string column to boolean columns, null as `{column}_nan`."""

    limit: int | None = None

    def fit(self, df: DataFrame) -> Plan:
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        return fit_one_hot(df, texts, null_label="nan", as_boolean=True, limit=self.limit)


# -- label encoding -----------------------------------------------------------

def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values with codes 0..n-1 in value order.

    The values are written, so sampling their ranges does not gather them again, and
    range-partitioned; each range is ranked on its own and shifted by the sizes of the ranges
    before it, so no task sorts the whole dictionary.
    """
    values = cut(df.select(col(column).alias("value")).where("value is not null").distinct(), "values")
    ranged = cut(values.repartitionByRange("value").withColumn("bucket", F.spark_partition_id()), "labels")
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # One row per range, so this window and its broadcast are as small as the partition count.
    offsets = ranged.groupBy("bucket").count().select(
        "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    rank = F.row_number().over(W.partitionBy("bucket").orderBy("value")) - 1
    return ranged.join(F.broadcast(offsets), "bucket").select("value", (F.col("start") + rank).alias("code"))


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Replace `column` by `encoded_{column}`."""
    codes = written_side(label_codes(df, column).withColumnsRenamed({"value": column, "code": f"encoded_{column}"}))
    return df.join(codes, column, "left").drop(column)


# -- sparse one-hot -----------------------------------------------------------

MOST_FLAGS = 2**31 - 1  # sizes and indices of a vector are 32-bit integers


@F.arrow_udf(VectorUDT())
def _as_vector(parts: pa.Array) -> pa.Array:
    """The fields of a vector as one: the type changes, nothing else."""
    return parts


@dataclass(frozen=True)
class SparseOneHotPlan:
    """Columns of any number of values as one sparse vector of flags.

    `codes` has a written table (value, code) per column; a column's flags begin where those
    of the columns before it end, values ascending and null last.
    """

    codes: tuple[tuple[str, DataFrame], ...]
    sizes: tuple[int, ...]  # flags per column
    has_null: tuple[bool, ...]
    output: str

    def apply(self, df: DataFrame) -> DataFrame:
        """The other columns, then the vector; a value that was not learned sets no flag.

        The vector's metadata has the number of flags, not their names: MLlib's own encoder and
        assembler keep an attribute per flag in the plan, and so on the driver.
        """
        if sum(self.sizes) > MOST_FLAGS:
            raise ValueError(f"{sum(self.sizes)} flags do not fit into a vector")
        names = [c for c, _ in self.codes]
        rest = [c for c in df.columns if c not in names]
        indices, start = [], 0
        for i, ((c, table), size, null) in enumerate(zip(self.codes, self.sizes, self.has_null)):
            own = table.select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__c{i}"))
            df = df.join(own, col(c) == F.col(f"__v{i}"), "left")
            unknown = F.when(col(c).isNull(), size - 1) if null else F.lit(None).cast("int")
            indices.append((F.coalesce(F.col(f"__c{i}").cast("int"), unknown) + start).alias(f"__c{i}"))
            start += size
        set_flags = F.array_compact(F.array(*indices))
        coded = df.select(*[col(c) for c in rest], set_flags.alias("__set"))
        parts = F.struct(
            F.lit(0).cast("tinyint").alias("type"), F.lit(start).alias("size"), F.col("__set").alias("indices"),
            F.transform("__set", lambda _: F.lit(1.0)).alias("values"),
        )
        flags = _as_vector(parts).alias(self.output, metadata={"ml_attr": {"num_attrs": start}})
        return coded.select(*[col(c) for c in rest], flags)

    def positions(self) -> DataFrame:
        """(position, column, value): what each flag of the vector stands for."""
        parts, start = [], 0
        for (c, table), size, null in zip(self.codes, self.sizes, self.has_null):
            parts.append(table.select((F.lit(start) + F.col("code")).alias("position"), F.lit(c).alias("column"),
                                      F.col("value").cast("string").alias("value")))
            if null:
                row = table.sparkSession.range(1).select(
                    (F.lit(start + size - 1).cast("bigint")).alias("position"), F.lit(c).alias("column"),
                    F.lit(None).cast("string").alias("value"),
                )
                parts.append(row)
            start += size
        return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class SparseOneHot:
    """Chain stage: the named columns to one sparse vector; their values never reach the driver."""

    columns: tuple[str, ...]
    output: str = "flags"

    def fit(self, df: DataFrame) -> SparseOneHotPlan:
        codes = tuple((c, written_side(label_codes(df, c), "codes")) for c in self.columns)
        row = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(self.columns)]).first()
        nulls = tuple(row[f"n{i}"] > 0 for i in range(len(self.columns)))
        sizes = tuple(table.count() + null for (_, table), null in zip(codes, nulls))
        return SparseOneHotPlan(codes, sizes, nulls, self.output)


# -- components of boolean columns --------------------------------------------


@dataclass(frozen=True)
class PcaPlan:
    """A linear map of a vector of flags: centred, projected, each component signed."""

    columns: tuple[str, ...]
    models: tuple[Transformer, ...]
    n_components: int

    @property
    def loadings(self) -> tuple[tuple[float, ...], ...]:
        """The weights of the flags in each component."""
        _, components, signed = self.models
        return tuple(map(tuple, (components.pc.toArray() * signed.getScalingVec().toArray()).T.tolist()))

    def apply(self, df: DataFrame) -> DataFrame:
        """The other columns, then the components as `x_0`, `x_1`, ..."""
        keep = [col(c) for c in df.columns if c not in self.columns]
        if not self.columns:
            return df.select(*keep)
        mapped = df.select(*keep, _flag_vector(self.columns).alias("__v"))
        for model in self.models:
            mapped = model.transform(mapped)
        parts = vector_to_array("__x")
        return mapped.select(*keep, *[parts[i].alias(f"x_{i}") for i in range(self.n_components)])


def _flag_vector(flags: tuple[str, ...]) -> Column:
    return array_to_vector(F.array(*[F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in flags]))


@dataclass(frozen=True)
class ReduceBooleans:
    """Chain stage: the boolean columns to round(sqrt(n)) principal components.

    Components are centred and signed so that the first of the largest loadings is positive;
    loadings within rounding of the largest count as equal, so the sign does not depend on
    how rows are partitioned. A missing flag counts as false.
    """

    def fit(self, df: DataFrame) -> Plan:
        flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
        k = round(math.sqrt(len(flags)))
        if not flags:
            return PcaPlan((), (), 0)
        vectors = df.select(_flag_vector(tuple(flags)).alias("__v"))
        centred = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(vectors)
        model = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred.transform(vectors))
        pc = model.pc.toArray()
        leads = [column[int((abs(column) >= abs(column).max() - 1e-9).argmax())] for column in pc.T]
        signs = Vectors.dense([1.0 if lead >= 0 else -1.0 for lead in leads])
        signed = ElementwiseProduct(scalingVec=signs, inputCol="__p", outputCol="__x")
        return PcaPlan(tuple(flags), (centred, model, signed), k)
