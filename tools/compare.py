"""Compare named queries with their SQL on one data folder: ``python tools/compare.py [-d folder] [name ...]``."""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    from quarrymark.sources.tables import TABLES

    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, folder: str) -> tuple[str, int, float, float, str]:
    from quarrymark.sources.tables import Tables

    t0 = time.time()
    frame = query.build(Tables(spark, folder))
    mine_rows = [tuple(r) for r in frame.collect()]
    t1 = time.time()
    mine = canonical(frame.columns, mine_rows)
    if query.sql is None:
        return "rows-only", len(mine), t1 - t0, 0.0, ""
    rel = con.sql(query.sql)
    theirs = canonical(rel.columns, rel.fetchall())
    t2 = time.time()
    if sorted(frame.columns) != sorted(rel.columns):
        return "MISMATCH", len(mine), t1 - t0, t2 - t1, f"columns {frame.columns} vs {rel.columns}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        note = f"{len(mine)} vs {len(theirs)} rows\n   spark-only {sorted(a - b)[:3]}\n   sql-only   {sorted(b - a)[:3]}"
        return "MISMATCH", len(mine), t1 - t0, t2 - t1, note
    return "ok", len(mine), t1 - t0, t2 - t1, ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("-d", default="/root/testdata/sf0.01")
    parser.add_argument("-m", default=None, help="only queries of this module")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()

    from quarrymark.plans.catalogue import CATALOGUE
    from quarrymark.session import build_session

    spark = build_session("local[8]", driver_memory="8g", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.d)
    names = args.names or [
        n for n, q in CATALOGUE.items() if args.m is None or q.build.__module__.endswith(args.m)
    ]
    bad = 0
    for name in names:
        try:
            status, n, ts, td, note = compare(spark, con, CATALOGUE[name], args.d)
        except Exception as exc:  # report and go on with the other queries
            status, n, ts, td, note = "ERROR", 0, 0.0, 0.0, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += status in ("MISMATCH", "ERROR")
        print(f"{status:10s} {name:32s} rows={n:<8d} spark={ts:6.2f}s sql={td:6.2f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
