"""Runs a query and its SQL on the same tables and tells how they differ."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, list | tuple):
        return tuple(map(_plain, x))
    return float(x) if type(x).__name__ == "Decimal" else x


def difference(df, con, sql: str) -> str:
    """Empty if columns and rows agree."""
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    cols = sorted(df.columns)
    mine = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows: {sorted(set(mine) ^ set(theirs), key=repr)[:4]}"
    odd = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(odd)} of {len(mine)} rows: {odd[0]}" if odd else ""
