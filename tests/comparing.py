"""Spark rows against DuckDB rows, without regard to order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck_rows(sql: str, sf: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    table = con.sql(sql).to_arrow_table()
    return table.column_names, [tuple(r.values()) for r in table.to_pylist()]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(f"{float(v):.9g}")
    return str(v)


def same_rows(df, sql: str, sf: str) -> None:
    names, want = duck_rows(sql, sf)
    order = sorted(df.columns)
    assert sorted(names) == order
    got = sorted(((*(plain(r[c]) for c in order),) for r in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    want = sorted(((*(plain(r[i]) for i in at),) for r in want), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-9)) for x, y in zip(a, b)), (a, b)
