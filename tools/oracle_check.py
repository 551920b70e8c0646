"""Run registered Spark queries and their DuckDB oracle side by side.

usage: python tools/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows spark/oracle, schema and value match.
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

from tessera.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from tessera.plans.registry import entries
    from tessera.session import get_spark

    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    ents = entries()
    bad = 0
    for name, e in ents.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = e.fn(spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if e.oracle is None:
            print(f"ROWS {name}: spark={len(srows)} ({ts:.1f}s) no oracle")
            continue
        try:
            cur = con.execute(e.oracle)
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: oracle error {str(exc)[:400]}")
            bad += 1
            continue
        sc, sr = canon(scols, srows)
        oc, orr = canon(ocols, orows)
        ok = sc == oc and sr == orr
        if not ok:
            bad += 1
            print(f"DIFF {name}: rows {len(sr)}/{len(orr)} cols {sc} vs {oc}")
            ss, oo = set(sr), set(orr)
            print("   spark-only:", list(ss - oo)[:3])
            print("   oracle-only:", list(oo - ss)[:3])
        else:
            print(f"OK   {name}: rows={len(sr)} ({ts:.1f}s)")
    print(f"done, {bad} problems")
    spark.stop()


if __name__ == "__main__":
    main()
