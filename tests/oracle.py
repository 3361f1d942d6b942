"""Runs registered queries beside their SQL twins in DuckDB.

    python -m tests.oracle [--sf DIR] [query ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.01"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=repr
    )


def compare(spark, con, name, query, sql, sf):
    start = time.time()
    frame = query(spark, sf)
    names, rows = _sorted(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - start
    if sql is None:
        return f"rows-only {len(rows)}", took, True
    cur = con.execute(sql)
    want_names, want = _sorted([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}", took, False
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}", took, False
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    types = {
        n: (type(a).__name__, type(b).__name__)
        for a, b in zip(rows, want)
        for n, a, b in zip(names, a, b)
        if a is not None and b is not None and type(a) is not type(b)
    }
    if types:
        return f"types differ {types}", took, False
    if bad:
        return f"{len(bad)}/{len(rows)} rows differ, e.g.\n   spark {bad[0][0]}\n   sql   {bad[0][1]}", took, False
    return f"match {len(rows)} rows", took, True


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default=SF)
    p.add_argument("names", nargs="*")
    args = p.parse_args()
    import __spark_entry__ as entry
    from txrisk.session import build_session

    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = build_session("oracle", "local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, twins = entry.queries(), entry.oracle_sql()
    failed = []
    for name in args.names or queries:
        try:
            text, took, ok = compare(spark, con, name, queries[name], twins.get(name), args.sf)
        except Exception as e:  # noqa: BLE001
            text, took, ok = f"{type(e).__name__}: {str(e)[:600]}", 0.0, False
        print(f"{'ok  ' if ok else 'FAIL'} {name:30s} {took:6.2f}s {text}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
