"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        source = path / "*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return int(value) if isinstance(value, int) and not isinstance(value, bool) else value


def compare(spark, query, sql: str, sf_dir: str) -> list[str]:
    """Differences, best first; empty when both results are the same bag of rows."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = connect(sf_dir).sql(sql)
    if sorted(rel.columns) != names:
        return [f"columns {names} and {sorted(rel.columns)}"]
    at = [rel.columns.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if got == want:
        return [] if got else ["no rows"]
    return [f"{sum(got.values())} rows and {sum(want.values())}", f"only Spark: {list((got - want).items())[:4]}", f"only SQL: {list((want - got).items())[:4]}"]
