"""Compares a query's rows with those of its SQL in DuckDB on the same files."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    """A value as both engines show it; floats to nine significant digits."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v


def assert_same(frame, con, sql: str) -> int:
    """The same columns and the same bag of rows. Returns how many rows there are."""
    names = sorted(frame.columns)
    mine = sorted(repr([plain(r[c]) for c in names]) for r in frame.collect())
    found = con.execute(sql)
    theirs_names = [d[0] for d in found.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
    assert len(mine) == len(theirs)
    off = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert not off, f"{len(off)} rows differ, first {off[0]}"
    return len(mine)
