"""Compare queries with their SQL: python tests/oracle.py [FOLDER] [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings entries ops snapshots trigger_entries triggers shares eval_items".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if hasattr(value, "asDict"):
        return tuple(plain(x) for x in value)
    return value


def bag(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str, folder: str) -> str:
    df = query(spark, folder)
    left = bag(df.collect(), df.columns)
    result = con.sql(sql)
    right = bag(result.fetchall(), result.columns)
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} / {sorted(result.columns)}"
    if left != right:
        return f"{sum(left.values())} / {sum(right.values())} rows; only Spark {list((left - right).items())[:3]}; only SQL {list((right - left).items())[:3]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from mnemoria.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    sql, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        began = time.time()
        try:
            said = compare(spark, con, name, query, sql[name], folder) if name in sql else f"rows {query(spark, folder).count()} (no SQL)"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad += bool(said) and "(no SQL)" not in said
        print(f"{name:28s} {time.time() - began:6.1f} s  {said or 'ok'}", flush=True)
    print("bad:", bad)
