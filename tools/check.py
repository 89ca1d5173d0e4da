"""Run registered queries against their DuckDB oracles.

    python tools/check.py [--sf 0.01] [--time] [name-or-substring ...]
"""

from __future__ import annotations

import argparse
import importlib.util
import math
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("f", round(v, 6) + 0.0)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    return (type(v).__name__, str(v))


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--explain", action="store_true")
    args = ap.parse_args()
    spec = importlib.util.spec_from_file_location("entry", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    from sparkdesk.session import build_session

    spark = build_session("local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    qs, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if args.names and not any(n in name for n in args.names):
            continue
        try:
            t = time.time()
            df = fn(spark, sf_dir)
            if args.explain:
                df.explain("formatted")
            got = [tuple(r) for r in df.collect()]
            took = time.time() - t
            if name not in oracle:
                print(f"ROWS  {name} {len(got)} {took:.1f}s", got[:1], flush=True)
                continue
            t = time.time()
            cur = con.execute(oracle[name])
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            otook = time.time() - t
            if sorted(cols) != sorted(df.columns):
                bad += 1
                print(f"FAIL  {name} columns {sorted(df.columns)} vs {sorted(cols)}")
                continue
            a, b = rows(df.columns, got), rows(cols, want)
            if a == b:
                print(f"OK    {name} {len(a)} {took:.1f}s (duckdb {otook:.1f}s)" + ("  EMPTY" if not a else ""), flush=True)
            else:
                bad += 1
                print(f"FAIL  {name} rows {len(a)} vs {len(b)} cols {sorted(cols)}")
                sa, sb = set(map(repr, a)), set(map(repr, b))
                for r in list(sa - sb)[:2]:
                    print("   spark :", r[:600])
                for r in list(sb - sa)[:2]:
                    print("   duckdb:", r[:600])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(e)[:1200]}", flush=True)
    print("failures:", bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
