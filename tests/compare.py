"""Compare a Spark result with DuckDB's, column by column and row by row in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"SET threads = {os.environ.get('TEST_CPUS', '8')}")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return repr(x) if x is not None else "null"


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    got = rows_of(df.columns, df.collect())
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want = rows_of(names, res.fetchall())
    out = []
    if sorted(df.columns) != sorted(names):
        out.append(f"columns {sorted(df.columns)} and {sorted(names)}")
    if len(got) != len(want):
        out.append(f"{len(got)} rows and {len(want)}")
    a, b = set(got), set(want)
    out += [f"only in Spark: {x}" for x in sorted(a - b)[:3]] + [f"only in SQL: {x}" for x in sorted(b - a)[:3]]
    return out
