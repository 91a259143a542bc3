"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def _cell(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list | tuple):
        return tuple(_cell(v) for v in x)
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in records), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def difference(df, con, sql: str) -> str:
    """Empty if the results agree: columns, row count, values, and kinds of types."""
    got = df.collect()
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    expected = want.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(expected):
        return f"{len(got)} rows and {len(expected)}"
    a, b = rows([tuple(r) for r in got], df.columns), rows(expected, names)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[0]}" if bad else ""
