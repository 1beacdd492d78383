"""Run registered queries beside their SQL and compare the results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _bag(rows, order):
    return Counter(tuple(repr(_plain(r[i])) for i in order) for r in rows)


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    df = fn(spark, sf_dir)
    names = df.columns
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return "" if rows else "no rows"
    cur = con.execute(sql)
    other_names = [d[0] for d in cur.description]
    if sorted(names) != sorted(other_names):
        return f"columns {sorted(names)} / {sorted(other_names)}"
    others = cur.fetchall()
    a = _bag(rows, sorted(range(len(names)), key=lambda i: names[i]))
    b = _bag(others, sorted(range(len(names)), key=lambda i: other_names[i]))
    if a == b:
        return ""
    left, right = sorted((a - b).elements())[:3], sorted((b - a).elements())[:3]
    return f"{sorted(names)} rows {len(rows)} / {len(others)}; only spark {left}; only sql {right}"


def main():
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = make_session(), connect(sf_dir)
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            problem = compare(spark, con, fn, sqls.get(name), sf_dir)
        except Exception as e:
            traceback.print_exc(limit=-6) if wanted else None
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        mark = "FAIL" if problem else "ok  " if name in sqls else "rows"
        print(f"{mark} {name} {time.time() - began:.1f}s {problem}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
