"""Holds a query against its DuckDB SQL on a folder of tables."""

from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def connection(sf_dir: str = SMALL):
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else format(value, ".9g") if value else "0"
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else str(value)


def agree(df, sql: str, c) -> None:
    expected = c.sql(sql)
    columns = sorted(expected.columns)
    assert sorted(df.columns) == columns
    place = [expected.columns.index(k) for k in columns]
    assert sorted(tuple(plain(r[k]) for k in columns) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in place) for r in expected.fetchall())
