"""Run registered queries beside their SQL on the same tables and report differences.

    python check.py [name ...]        CHECK_SF_DIR=/path  (default sf0.01)
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

from ratewright.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}


def compare(spark, con, sf_dir, run, sql):
    """(rows, seconds, problem or None) of one query."""
    start = time.time()
    df = run(spark, sf_dir)
    got = df.collect()
    seconds = time.time() - start
    if not sql:
        return len(got), seconds, None
    result = con.sql(sql)
    names, want = result.columns, result.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), seconds, f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {n: TYPES.get(str(t), str(t)) for n, t in zip(names, result.types)}
    other = {n: (t, kinds[n]) for n, t in df.dtypes if kinds[n] != t}
    if other:
        return len(got), seconds, f"types (ours, sql): {other}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        here = [x for x in a if x not in set(b)][:3]
        there = [x for x in b if x not in set(a)][:3]
        return len(got), seconds, f"{len(a)} rows vs {len(b)}; only ours {here}; only sql {there}; {sorted(names)}"
    return len(got), seconds, None


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def main() -> int:
    from catalog.registry import ALL_QUERIES

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con, bad = local_session("check"), connect(sf_dir), 0
    for name in sys.argv[1:] or ALL_QUERIES:
        run, sql = ALL_QUERIES[name]
        try:
            rows, seconds, problem = compare(spark, con, sf_dir, run, sql)
        except Exception as error:  # report and go on with the other queries
            rows, seconds, problem = 0, 0.0, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        mark = "ok  " if not problem else "FAIL"
        print(f"{mark} {name:34s} {rows:7d} rows {seconds:6.2f} s{'' if sql else '  (rows only)'}", flush=True)
        if problem:
            print("     ", problem, flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
