"""Runs a registered query next to its SQL text and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _cell(value):
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("null",) if math.isnan(value) else ("num", value)
    if isinstance(value, int):
        return ("num", float(value))
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, build, sql, sf_dir):
    """(names match, types, spark rows, sql rows)."""
    df = build(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    kinds = dict(zip(names, [str(d[1]) for d in result.description]))
    return sorted(df.columns), sorted(names), {f.name: f.dataType.simpleString() for f in df.schema}, kinds, mine, theirs
