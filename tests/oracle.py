"""Holds a query's rows against its SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def sql_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    if isinstance(value, list):
        return tuple(map(plain, value))
    return value


def difference(df, sf_dir: str, sql: str) -> str:
    """Empty if the rows are the same; else what differs first."""
    names, want = sql_rows(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(names)} and {sorted(df.columns)}"
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows, the SQL has {len(want)}"
    for g, w in zip(got, want, strict=True):
        for c, x, y in zip(order, g, w, strict=True):
            if x != y and not (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)):
                return f"{c}: {x!r} and {y!r} in {g} and {w}"
    return ""
