"""Side-by-side comparison with DuckDB: rows as sorted lists of canonical texts."""

from __future__ import annotations

from datetime import date, datetime, time
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def shown(value) -> str:
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):  # sums of doubles depend on their order
        return f"{value:.9g}"
    return str(datetime.combine(value, time())) if type(value) is date else str(value)


def rows_of(columns: list[str], rows) -> list[list[str]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([shown(r[i]) for i in order] for r in rows)


def same(df, con, sql: str) -> None:
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall())
