"""Compare a query with its DuckDB SQL: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def differences(df, sql: str, folder: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    got = c.execute(sql)
    names = [x[0] for x in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    theirs = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in got.fetchall()), key=key)
    mine = sorted((tuple(plain(r.asDict(recursive=True)[n]) for n in order) for r in df.collect()), key=key)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}: {[x for x in mine if x not in set(theirs)][:3]} / {[x for x in theirs if x not in set(mine)][:3]}"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ: {bad[:3]}" if bad else ""
