"""Run registered queries next to their SQL and compare values.

    python tests/compare.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canon(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        value = float(value)
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6) + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, folder):
    df = fn(spark, folder)
    start = time.time()
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    compare.spark_seconds = time.time() - start
    if sql is None:
        return len(got), None
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} / {sorted(names)}"
    if got != want:
        diff = next(((g, w) for g, w in zip(got, want) if g != w), None)
        bad = sum(g != w for g, w in zip(got, want))
        return len(got), f"rows {len(got)}/{len(want)} differing {bad} first {str(diff)[:1500]} cols {sorted(names)}"
    return len(got), ""


def main() -> None:
    import __spark_entry__ as entry
    from newsgraph.session import spark_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = spark_session(cores="8")
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            n, problem = compare(spark, con, fn, oracle.get(name), folder)
        except Exception as exc:  # report and go on
            n, problem = -1, f"{type(exc).__name__}: {str(exc)[:900]}"
        state = "rows-only" if problem is None else ("ok" if not problem else "FAIL")
        bad += bool(problem)
        print(f"{state:9} {name:40} {n:7} {time.time() - start:6.2f}s ({getattr(compare, 'spark_seconds', 0):5.2f}) {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
