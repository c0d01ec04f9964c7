"""Run registered queries and their check SQL side by side and report differences.

usage: python tools/check_queries.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from boxtally.plans.catalogue import ORACLES, QUERIES  # noqa: E402
from boxtally.session import local_session  # noqa: E402

SECONDS: dict[str, tuple[float, float]] = {}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else value
    return value


def ordered(rows, names):
    index = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in index) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when the query equals its check SQL, else what differs."""
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    t1 = time.time()
    if name not in ORACLES:
        return None
    cur = con.execute(ORACLES[name])
    SECONDS[name] = (t1 - t0, time.time() - t1)
    names = [d[0] for d in cur.description]
    want = ordered(cur.fetchall(), names)
    got = ordered([tuple(r) for r in rows], df.columns)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]} {sorted(names)}"
    types = {type(v).__name__ for r in got for v in r} ^ {type(v).__name__ for r in want for v in r}
    return f"types {types}" if types else None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failed = 0
    for name in QUERIES:
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t0 = time.time()
        try:
            problem = compare(spark, con, name, args.sf)
        except Exception as exc:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(exc))[:1500]
        mark = "ok  " if problem is None else "FAIL"
        failed += problem is not None
        kind = "" if name in ORACLES else " (no sql)"
        print(f"{mark} {name}{kind} {time.time() - t0:.1f}s {SECONDS.get(name, '')} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
