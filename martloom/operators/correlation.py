"""Pairwise correlation with nulls left out per pair, and the filter built on it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.functions.values import is_numeric, present_sql, quoted
from martloom.operators.plan import DropColumns, Identity, Plan
from martloom.operators.profile import profile

MOMENTS = "i int, j int, n double, mx double, my double, cxy double, mxx double, myy double"
# A pair whose second moment is this small beside the squares it was taken from is summed again about its own means.
LOOSE = 1e-6
# Deviation, relative to the mean, that is rounding and no variance.
DUST = 1e-12


def _batch_moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean, cxy, mxx) over the complete pairs of one batch.

    `mean[i, j]` and `mxx[i, j]` are those of column i over the rows where j is there too.
    Sums about the column means come from matrix products; pairs for which these are no good
    measure, as few rows far from the column's mean make them, are taken one by one.
    """
    there = ~np.isnan(x)
    mask = there.astype("float64")
    count = mask.sum(axis=0)
    shift = np.divide(np.where(there, x, 0.0).sum(axis=0), count, out=np.zeros(len(count)), where=count > 0)
    z = np.where(there, x - shift, 0.0)
    n = mask.T @ mask
    some = np.maximum(n, 1.0)
    sums, squares = z.T @ mask, (z * z).T @ mask
    mxx = squares - sums * sums / some
    cxy = z.T @ z - sums * sums.T / some
    mean = shift[:, None] + sums / some
    bad = (n > 0) & ~(mxx >= LOOSE * squares)
    for i, j in zip(*np.nonzero(np.triu(bad | bad.T, 1))):
        both = there[:, i] & there[:, j]
        a, b = x[both, i], x[both, j]
        mean[i, j], mean[j, i] = a.mean(), b.mean()
        da, db = a - mean[i, j], b - mean[j, i]
        cxy[i, j] = cxy[j, i] = da @ db
        mxx[i, j], mxx[j, i] = da @ da, db @ db
    return n, mean, cxy, np.maximum(mxx, 0.0)


def _moments(k: int):
    """Per task: moments of every pair, each batch merged into what came before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, cxy, mxx = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns])
                more, other, c, m = _batch_moments(x)
                total = np.maximum(n + more, 1.0)
                apart = other - mean
                share = n * more / total
                cxy += c + apart * apart.T * share
                mxx += m + apart * apart * share
                mean += apart * more / total
                n += more
        i, j = np.triu_indices(k, 1)
        arrays = [i.astype("int32"), j.astype("int32"), n[i, j], mean[i, j], mean[j, i], cxy[i, j], mxx[i, j], mxx[j, i]]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[f.split()[0] for f in MOMENTS.split(", ")])

    return run


# Two partial results put together, as the variance aggregates of Spark do it.
MERGE = """
    aggregate(parts, named_struct('n', 0D, 'mx', 0D, 'my', 0D, 'cxy', 0D, 'mxx', 0D, 'myy', 0D),
      (a, b) -> if(b.n = 0, a, named_struct(
        'n', a.n + b.n,
        'mx', a.mx + (b.mx - a.mx) * b.n / (a.n + b.n),
        'my', a.my + (b.my - a.my) * b.n / (a.n + b.n),
        'cxy', a.cxy + b.cxy + (b.mx - a.mx) * (b.my - a.my) * a.n * b.n / (a.n + b.n),
        'mxx', a.mxx + b.mxx + (b.mx - a.mx) * (b.mx - a.mx) * a.n * b.n / (a.n + b.n),
        'myy', a.myy + b.myy + (b.my - a.my) * (b.my - a.my) * a.n * b.n / (a.n + b.n))))
"""


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col1, col2, corr) for every pair of numeric columns; null where undefined."""
    names = [f.name for f in df.schema.fields if is_numeric(f.dataType) and (columns is None or f.name in columns)]
    types = {f.name: f.dataType for f in df.schema.fields}
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, corr double")
    data = df.selectExpr(*[f"cast({present_sql(c, types[c])} as double) as {quoted(c)}" for c in names])
    # Every task sends one row per pair, so the task count is held near the core count.
    tasks = data.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    parts = tasks.mapInArrow(_moments(len(names)), MOMENTS).groupBy("i", "j").agg(
        F.collect_list(F.struct("n", "mx", "my", "cxy", "mxx", "myy")).alias("parts")
    )
    sums = parts.select("i", "j", F.expr(MERGE).alias("m")).select("i", "j", "m.*")
    # A constant column may leave rounding dust instead of an exact zero variance.
    flat = F.lit(False)
    for second, mean in (("mxx", "mx"), ("myy", "my")):
        flat = flat | (F.col(second) <= F.col("n") * F.pow(F.lit(DUST) * F.col(mean), F.lit(2)))
    lookup = F.array(*[F.lit(c) for c in names])
    return sums.select(
        lookup[F.col("i")].alias("col1"),
        lookup[F.col("j")].alias("col2"),
        F.when(~flat & (F.col("n") > 0), F.try_divide(F.col("cxy"), F.sqrt("mxx") * F.sqrt("myy"))).alias("corr"),
    )


@dataclass(frozen=True)
class DropCorrelated:
    """Drop one column of each pair correlated above the threshold.

    Pairs are visited in column order and a pair that touches a dropped column is passed
    over. `prefer="fewer_nulls_first"` drops the first column when it has no more nulls than the
    second, else the second; `prefer="fewest_nulls"` keeps the column with fewer nulls.
    Negative correlation counts only with `absolute=True`. A pair with an infinite value has
    no correlation and is passed over.
    """

    threshold: float = 0.95
    ignore: tuple[str, ...] = ()
    prefer: str = "fewer_nulls_first"
    absolute: bool = False

    def fit(self, df: DataFrame) -> Plan:
        names = [f.name for f in df.schema.fields if f.name not in self.ignore and is_numeric(f.dataType)]
        if len(names) < 2:
            return DropColumns(())
        p = profile(df, names, want=("nulls",))
        if not p.n_rows:
            return Identity()
        corr = correlations(df, names)
        strength = F.abs("corr") if self.absolute else F.col("corr")
        # Pairs of columns, not rows: at most columns^2 / 2 come to the driver.
        high = {(r["col1"], r["col2"]) for r in corr.where((strength > self.threshold) & ~F.isnan(strength)).collect()}
        dropped: set[str] = set()
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                if (a, b) not in high or a in dropped or b in dropped:
                    continue
                if self.prefer == "fewer_nulls_first":
                    drop_first = p[a].n_null <= p[b].n_null
                else:
                    drop_first = p[a].n_null >= p[b].n_null
                dropped.add(a if drop_first else b)
        return DropColumns(tuple(c for c in names if c in dropped))
