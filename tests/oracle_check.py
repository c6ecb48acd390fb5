"""Run registered queries in Spark and their SQL twins in DuckDB; compare.

Usage:  python tests/oracle_check.py [sf_dir] [name ...]
Comparison: same column names (order-insensitive), same row count, same
multiset of rows (values normalised: floats exact, NaN as NULL).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:  # noqa: BLE001
            pass
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, repr(x)) for x in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols, tol=0.0):
    if sorted(spark_cols) != sorted(duck_cols):
        return False, f"columns differ: {sorted(spark_cols)} vs {sorted(duck_cols)}"
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in spark_rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in duck_rows), key=_key)
    if len(a) != len(b):
        return False, f"row count {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        for c, u, v in zip(order, x, y):
            if u == v:
                continue
            if isinstance(u, (int, float)) and isinstance(v, (int, float)) and tol and \
                    abs(u - v) <= tol * max(1.0, abs(u), abs(v)):
                continue
            return False, f"value differs in {c}: {u!r} vs {v!r}\n spark={x}\n duck ={y}"
    return True, f"{len(a)} rows"


def run(sf_dir, names=None, spark=None, verbose=True):
    from __spark_entry__ import oracle_sql, queries
    from tallyframe.session import build_session
    spark = spark or build_session("local[8]", shuffle_partitions=8)
    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = (False, f"spark error: {str(e)[:500]}")
            if verbose:
                print(f"FAIL {name}: spark error {str(e)[:500]}", flush=True)
            continue
        if name not in sqls:
            results[name] = (True, f"rows-only: {len(rows)} rows")
            if verbose:
                print(f"ROWS {name}: {len(rows)} rows ({time.time() - t:.1f}s)", flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = (False, f"duckdb error: {str(e)[:500]}")
            if verbose:
                print(f"FAIL {name}: duckdb error {str(e)[:500]}", flush=True)
            continue
        ok, msg = compare(rows, cols, drows, dcols)
        results[name] = (ok, msg)
        if verbose:
            print(f"{'OK  ' if ok else 'FAIL'} {name}: {msg} ({time.time() - t:.1f}s)", flush=True)
    return results


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    res = run(sf, sys.argv[2:] or None)
    bad = [k for k, (ok, _) in res.items() if not ok]
    print(f"{len(res) - len(bad)}/{len(res)} ok; failing: {bad}")
