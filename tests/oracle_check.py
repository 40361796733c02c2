"""Run every query next to its SQL and compare names, row counts and values."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from rowscrub.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, folder: str) -> str | None:
    """``None`` if equal, else what differs."""
    df = entry.queries()[name](spark, folder)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        only = [str(x)[:300] for x in list((a - b).elements())[:2]], [str(x)[:300] for x in list((b - a).elements())[:2]]
        return f"{len(got)} rows / {len(want)} rows; spark only {only[0]}; sql only {only[1]}"
    return None


if __name__ == "__main__":
    folder = sys.argv[1]
    chosen = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in chosen:
        start = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} of {len(chosen)} failed; without SQL: {sorted(set(chosen) - set(entry.oracle_sql()))}")
