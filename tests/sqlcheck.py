"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import os
from pathlib import Path

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=str)


def same(spark, con, query, sql):
    df = query(spark, TABLES)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())
