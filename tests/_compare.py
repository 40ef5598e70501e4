"""Rows of a Spark query against rows of the equal SQL on DuckDB, whatever their order."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(sql: str, folder: str):
    db = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    got = db.execute(sql)
    names = [c[0] for c in got.description]
    return sorted(names), rows_of(names, got.fetchall())


def compare(spark, query, sql: str, folder: str) -> str | None:
    """None if equal, else the first difference."""
    df = query(spark, folder)
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    names, want = oracle(sql, folder)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} not {names}"
    if len(have) != len(want):
        return f"{len(have)} rows, not {len(want)}; only here {list(set(have) - set(want))[:2]}; only there {list(set(want) - set(have))[:2]}"
    return next((f"{a} not {b}" for a, b in zip(have, want, strict=True) if a != b), None)
