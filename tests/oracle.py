"""Runs a query and its SQL side by side on one folder of tables."""

from __future__ import annotations

from pathlib import Path

import duckdb


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return con


def _cell(v) -> str:
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.4f}" if abs(v) > 5e-5 else "0.0000"
    return str(v)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def same(frame, sql: str, folder: str) -> None:
    result = tables(folder).sql(sql)
    assert sorted(frame.columns) == sorted(result.columns)
    got, wanted = rows(frame.columns, frame.collect()), rows(result.columns, result.fetchall())
    assert len(got) == len(wanted)
    assert got == wanted
