"""Time profile, filters and correlation against the column count.

Columns are derived from lineitem at BENCH_SF_DIR. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from martloom.operators.correlation import DropCorrelated
from martloom.operators.filters import DropConstant, DropNullHeavy
from martloom.operators.narrowing import fit_narrowing
from martloom.operators.profile import profile
from martloom.operators.scaling import Scale
from martloom.session import cut, get_session

WIDTHS = (10, 100, 954)
BASE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey")


def wide(spark, sf: str, n: int):
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    cols = []
    for i in range(n):
        a, b = F.col(BASE[i % 6]), F.col(BASE[(i // 6) % 6])
        value = (a * (i % 7 + 1) + b * (i % 11)).cast("double")
        cols.append(F.when(F.pmod(F.col("l_orderkey") + i, F.lit(13)) != 0, value).alias(f"f{i}"))
    return cut(items.repartition(spark.sparkContext.defaultParallelism).select(*cols), f"wide{n}")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = get_session(
        "bench-wide",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "6g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="run-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {
        "profile": profile,
        "narrow": lambda df: fit_narrowing(df),
        "null_heavy": lambda df: DropNullHeavy().fit(df),
        "constant": lambda df: DropConstant().fit(df),
        "scale": lambda df: Scale().fit(df),
        "correlated": lambda df: DropCorrelated(threshold=0.9).fit(df),
    }
    out = {}
    for n in WIDTHS:
        df = wide(spark, sf, n)
        for name, job in jobs.items():
            began = time.perf_counter()
            job(df)
            out[f"{name}_{n}"] = round(time.perf_counter() - began, 2)
            print(name, n, out[f"{name}_{n}"], flush=True)
    print(json.dumps({"metric": "wide_seconds", "unit": "sec", "queries": out}))
    spark.stop()


if __name__ == "__main__":
    main()
