"""Run a registered query and its oracle side by side and compare them.

``python tests/oracle.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def database(folder: str):
    from plurispark.plans.registry import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value):
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.6g}" if abs(value) < 10**6 else str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str):
    """``(problem or None, number of rows, seconds)``."""
    from plurispark.plans import ORACLES, QUERIES

    began = time.time()
    df = QUERIES[name](spark, folder)
    got = df.collect()
    took = time.time() - began
    if name not in ORACLES:
        return (None if got else "no rows"), len(got), took
    answer = con.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    types = {d[0]: str(d[1]) for d in answer.description}
    want = answer.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got), took
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kinds = {"bigint": ("BIGINT",), "int": ("INTEGER",), "string": ("VARCHAR",), "double": ("DOUBLE",),
             "boolean": ("BOOLEAN",), "timestamp": ("TIMESTAMP", "TIMESTAMP WITH TIME ZONE"), "timestamp_ntz": ("TIMESTAMP",), "date": ("DATE",)}
    bad = [f"{c}: {mine[c]} vs {types[c]}" for c in columns if types[c] not in kinds.get(mine[c], (types[c],))]
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        left, right = set(a), set(b)
        only = [r for r in a if r not in right][:3], [r for r in b if r not in left][:3]
        return f"rows {len(a)} vs {len(b)}\n   spark only {only[0]}\n   oracle only {only[1]}", len(got), took
    if not a:
        return "no rows", 0, took
    return ("types " + "; ".join(bad) if bad else None), len(got), took


if __name__ == "__main__":
    from plurispark.plans import QUERIES
    from plurispark.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    for name in sys.argv[2:] or list(QUERIES):
        try:
            problem, n, took = compare(spark, con, folder, name)
        except Exception as e:  # report and go on
            problem, n, took = f"{type(e).__name__}: {str(e)[:1500]}", 0, 0.0
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={n} {took:.1f}s {problem or ''}", flush=True)
