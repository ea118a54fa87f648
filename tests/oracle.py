"""Comparison of a query's rows with DuckDB's, whatever their order."""

import os
from collections import Counter

import duckdb


def connect(folder):
    c = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}{'/*.parquet' if os.path.isdir(f'{folder}/{name}') else ''}'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def assert_same(df, connection, sql):
    found = connection.sql(sql)
    names = sorted(found.columns)
    assert sorted(df.columns) == names
    own = Counter(tuple(plain(v) for v in row) for row in df.select(*(f"`{n}`" for n in names)).collect())
    expected = Counter(tuple(plain(v) for v in row) for row in connection.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})").fetchall())
    missing, extra = expected - own, own - expected
    assert not missing and not extra, f"missing {list(missing)[:3]}, extra {list(extra)[:3]}"
