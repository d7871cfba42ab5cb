"""Run registered queries beside their SQL twins in DuckDB and compare whole results."""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, Decimal):
        return f"{value.normalize():f}" + "d"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(plain(r[i])).__name__, plain(r[i])) for i in order) for r in rows)


def compare(spark, con, run, sql, folder) -> str | None:
    """None when equal, otherwise what differs."""
    df = run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns: {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        extra, lacking = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"{len(got)} rows, oracle {len(want)}\n   only spark: {extra}\n   only oracle: {lacking}"
    if not got:
        return "both empty"
    return None


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from fleetloom.session import local_session

    folder = "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if not a.startswith("/")]
    for a in sys.argv[1:]:
        if a.startswith("/"):
            folder = a
    spark, con = local_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not names or any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            if name in oracles:
                difference = compare(spark, con, queries[name], oracles[name], folder)
            else:
                difference = None if queries[name](spark, folder).count() else "empty"
        except Exception as error:
            difference = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += difference is not None
        print(f"{'ok  ' if difference is None else 'FAIL'} {name} {time.time() - start:.1f}s"
              + ("" if name in oracles else " (no oracle)") + (f"\n   {difference}" if difference else ""), flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
