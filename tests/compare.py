"""Order-free comparison of a DataFrame with the rows of a reference SQL text."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
from pyspark.sql import DataFrame

from plumbgauge.catalogue.registry import TABLES


def open_reference(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.12g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, decimal.Decimal):
        return "decimal"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def _table(columns: list[str], rows: list[tuple]) -> tuple[list[tuple], dict[str, set[str]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    kinds = {columns[i]: {_kind(r[i]) for r in rows if r[i] is not None} for i in order}
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=repr), kinds


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str | None) -> tuple[str | None, int]:
    """What differs (or nothing) and the number of rows."""
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return (None if rows else "no rows"), len(rows)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(rows)
    ours, our_kinds = _table(df.columns, rows)
    theirs, their_kinds = _table(names, expected)
    if our_kinds != their_kinds:
        return f"types differ: {[(c, our_kinds[c], their_kinds[c]) for c in our_kinds if our_kinds[c] != their_kinds[c]]}", len(rows)
    if ours != theirs:
        only = [r for r in ours if r not in theirs][:3] if len(ours) < 5000 else ours[:1]
        missing = [r for r in theirs if r not in ours][:3] if len(theirs) < 5000 else theirs[:1]
        return f"{len(ours)} vs {len(theirs)} rows; ours {only}; expected {missing}", len(rows)
    return None, len(rows)
