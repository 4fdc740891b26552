"""Run registered queries next to their DuckDB statements and compare whole results.

    python tests/oracle_check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import tempfile
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='duckdb-')}'")  # not in the repository
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v).__name__), str(v)) for v in row)


def compare(df, con, sql: str) -> str | None:
    table = df.toArrow()
    names = sorted(table.column_names)
    got = [tuple(r[n] for n in names) for r in table.to_pylist()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    rows = cur.fetchall()
    if sorted(cols) != names:
        return f"columns {names} != {sorted(cols)}"
    idx = [cols.index(n) for n in names]
    want = [tuple(r[i] for i in idx) for r in rows]
    if len(got) != len(want):
        extra = sorted(set(map(str, got)) - set(map(str, want)))[:3]
        missing = sorted(set(map(str, want)) - set(map(str, got)))[:3]
        return f"rows {len(got)} != {len(want)}; spark only {extra}; duckdb only {missing}"
    got.sort(key=_key)
    want.sort(key=_key)
    for a, b in zip(got, want):
        for n, x, y in zip(names, a, b):
            if type(x) is not type(y):
                return f"type of {n}: {type(x).__name__} {x!r} != {type(y).__name__} {y!r} in {a} / {b}"
            if isinstance(x, float) and math.isnan(x) and math.isnan(y):
                continue
            if x != y:
                return f"value of {n}: {x!r} != {y!r} (names {names})\n   spark  {a}\n   duckdb {b}"
    return None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from verseline.session import local_session

    spark = local_session("oracle-check")
    con = duck(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t0 = time.time()
        try:
            if name in oracles:
                problem = compare(fn(spark, args.sf), con, oracles[name])
                tag = "ok" if problem is None else "BAD"
            else:
                n = fn(spark, args.sf).count()
                problem, tag = None, f"rows-only {n}"
        except Exception as exc:  # noqa: BLE001
            lines = [x for x in str(exc).splitlines() if x.strip()]
            problem, tag = "\n   ".join(lines[:6]) or repr(exc), "ERR"
            if not lines:
                traceback.print_exc()
        bad += problem is not None
        print(f"{tag:4} {name} {time.time() - t0:.2f}s" + (f"\n   {problem[:1500]}" if problem else ""), flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
