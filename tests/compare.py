"""Run registered queries on Spark and DuckDB and compare the rows.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def _order(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def canonical(columns, rows):
    """Rows with columns in name order, sorted, as plain values."""
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in place], sorted((tuple(_cell(r[i]) for i in place) for r in rows), key=_order)


def differences(con, name, spark_df, sql) -> str | None:
    """None when both sides agree exactly, else a short description."""
    cursor = con.execute(sql)
    wanted_cols, wanted = canonical([d[0] for d in cursor.description], cursor.fetchall())
    cols, rows = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if cols != wanted_cols:
        return f"columns {cols} != {wanted_cols}"
    if len(rows) != len(wanted):
        return f"{len(rows)} rows != {len(wanted)}"
    for a, b in zip(rows, wanted):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidemill.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(folder), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        started = time.monotonic()
        try:
            df = fn(spark, folder)
            found = differences(con, name, df, oracle[name]) if name in oracle else f"rows only: {len(df.collect())}"
        except Exception as error:
            found = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        spent = time.monotonic() - started
        wrong = found is not None and not found.startswith("rows only")
        bad += wrong
        print(f"{'BAD' if wrong else 'ok '} {name:32s} {spent:6.2f}s {found or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
