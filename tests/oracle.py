"""Compares a query with its SQL on the given tables."""

import math
import os

import duckdb


def connection(folder):
    c = duckdb.connect(config={"threads": 2})
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return f"{round(float(v), 5) + 0.0:.5f}"
    return str(v)


def close(a, b):
    if a == b:
        return True
    try:
        return abs(float(a) - float(b)) <= 2e-5 * max(1.0, abs(float(a)))
    except ValueError:
        return False


def check(spark, connection, folder, query, sql):
    got = query(spark, folder)
    names = sorted(got.columns)
    want = connection.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})").fetchall()
    rows = [tuple(r) for r in got.select(*[f"`{n}`" for n in names]).collect()]
    assert len(rows) == len(want)
    key = lambda r: tuple(map(plain, r))
    for a, b in zip(sorted(map(key, rows)), sorted(map(key, want))):
        assert all(map(close, a, b)), (names, a, b)
