"""Run registered queries beside their oracle SQL: python tools/check_oracle.py [-d DIR] [prefix ...]"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

import duckdb
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def type_name(t: pa.DataType) -> str:
    if pa.types.is_timestamp(t):
        return "timestamp"
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list<{type_name(t.value_type)}>"
    return str(t)


def cell(v) -> str:
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    if isinstance(v, list):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def rows(t: pa.Table, names: list[str]) -> list[tuple[str, ...]]:
    cols = [[cell(v) for v in t.column(n).to_pylist()] for n in names]
    return sorted(zip(*cols)) if cols else []


def compare(got: pa.Table, want: pa.Table) -> list[str]:
    problems = []
    a, b = sorted(got.schema.names), sorted(want.schema.names)
    if a != b:
        return [f"columns {sorted(set(a) - set(b))} | {sorted(set(b) - set(a))}"]
    for n in a:
        x, y = type_name(got.schema.field(n).type), type_name(want.schema.field(n).type)
        if x != y:
            problems.append(f"type {n}: {x} | {y}")
    if got.num_rows != want.num_rows:
        problems.append(f"rows {got.num_rows} | {want.num_rows}")
    ra, rb = rows(got, a), rows(want, a)
    if ra != rb:
        sa, sb = set(ra), set(rb)
        da, db = sorted(sa - sb), sorted(sb - sa)
        problems.append(f"values differ: {len(da)} | {len(db)}\n   {a}\n   {da[:3]}\n   {db[:3]}")
    return problems


def main() -> int:
    from riskloom.plans import registry
    from riskloom.session import local_session, scratch

    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    registry.load()
    spark = local_session(int(os.environ.get("CPUS", "8")))
    con = duck(args.d)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t0 = time.time()
        try:
            with scratch(spark):
                got = fn(spark, args.d).toArrow()
            took = time.time() - t0
            if name in registry.ORACLES:
                t0 = time.time()
                want = con.execute(registry.ORACLES[name]).to_arrow_table()
                problems = compare(got, want)
                if got.num_rows == 0:
                    problems.append("no rows")
                dt = time.time() - t0
            else:
                problems, dt = ([] if got.num_rows else ["no rows"]), 0.0
            state = "ok  " if not problems else "FAIL"
            print(f"{state} {name:34s} {got.num_rows:7d} rows {took:6.2f}s oracle {dt:5.2f}s{'' if name in registry.ORACLES else ' (rows only)'}", flush=True)
            for p in problems:
                print("     ", p[:1500], flush=True)
            bad += bool(problems)
        except Exception as e:
            bad += 1
            print(f"ERR  {name}: {str(e)[:900]}", flush=True)
            if not any(k in type(e).__name__ for k in ("Analysis", "Parse", "Binder", "Catalog", "Arithmetic", "Java")):
                traceback.print_exc(limit=-3, file=sys.stdout)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
