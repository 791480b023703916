"""Compare a query with its SQL in DuckDB: names, row counts and values without order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, str):
        return value
    return round(float(value), 5) + 0.0


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=lambda r: [(v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r])


def difference(frame, sql, con):
    """None, or what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(names)} and {sorted(frame.columns)}"
    want, got = rows(names, found.fetchall()), rows(frame.columns, [tuple(r) for r in frame.collect()])
    if len(want) != len(got):
        return f"{len(want)} rows and {len(got)}"
    for a, b in zip(want, got, strict=True):
        if any(x != y and not (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 + 1e-9 * abs(x)) for x, y in zip(a, b, strict=True)):
            return f"{a} and {b}"
    return None
