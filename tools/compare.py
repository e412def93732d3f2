"""Run registered queries against their oracle SQL: python tools/compare.py [sf] [name ...]

EXACT=1 compares doubles bit for bit instead of to nine decimals.
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldlens import catalog  # noqa: E402
from fieldlens.plans.fixtures import BASE  # noqa: E402
from fieldlens.session import build_session  # noqa: E402


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0 if os.environ.get("EXACT") else round(v, 9) + 0.0
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=repr)


def compare(spark, con, name, sf_dir):
    start = time.time()
    df = catalog.all_queries()[name](spark, sf_dir)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    sql = catalog.all_oracles().get(name)
    if sql is None:
        return "rows-only", len(got), took, ""
    start = time.time()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = _rows(want_cols, cur.fetchall())
    sql_took = time.time() - start
    note = f"sql {sql_took:.1f}s"
    if got_cols != want_cols:
        return "COLUMNS", len(got), took, f"{got_cols} vs {want_cols}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return "VALUES", len(got), took, f"{len(got)} vs {len(want)} {got_cols} spark-only {extra} oracle-only {missing}"
    spark_types = dict(df.dtypes)
    map_ = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp": "TIMESTAMP", "float": "FLOAT"}
    bad = {c: (t, types[c]) for c, t in spark_types.items() if map_.get(t, t) != types[c]}
    if bad:
        note += f" TYPES {bad}"
    if not got:
        note += " EMPTY"
    return "ok", len(got), took, note


def main(argv):
    sf = argv[0] if argv else "sf0.01"
    names = argv[1:]
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    failed = 0
    for name in names or catalog.all_queries():
        try:
            status, rows, took, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            status, rows, took, note = "ERROR", -1, 0.0, f"{type(e).__name__}: {str(e)[:700]}"
        failed += status not in ("ok", "rows-only")
        print(f"{status:10s} {name:28s} rows={rows:<8d} {took:6.2f}s {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
