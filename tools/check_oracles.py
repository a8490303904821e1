"""Run every registered query in Spark and its oracle in DuckDB; report mismatches.

Usage: python tools/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from qualis.catalog import ORACLES, QUERIES  # noqa: E402
from qualis.session import build_session  # noqa: E402
from qualis.sources import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in ORACLES:
            print(f"ROWS {n}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(ORACLES[n])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        sc, sr = rows_of(scols, srows)
        dc, dr = rows_of(dcols, drows)
        if sc != dc:
            print(f"FAIL {n}: columns differ\n  spark  {sc}\n  duckdb {dc}")
            bad += 1
            continue
        if sr != dr:
            bad += 1
            print(f"FAIL {n}: {len(sr)} vs {len(dr)} rows")
            ss, ds = set(sr), set(dr)
            for r in list(ss - ds)[:4]:
                print("   spark only ", r)
            for r in list(ds - ss)[:4]:
                print("   duckdb only", r)
            continue
        ok += 1
        print(f"OK   {n}: {len(sr)} rows {ts:.1f}s")
    print(f"{ok} ok, {bad} failed, {len(names)} total")


if __name__ == "__main__":
    main()
