"""Rows of Spark and DuckDB in one form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or (isinstance(x, float) and x != x):
        return "~"
    return tuple(map(value, x)) if isinstance(x, (list, tuple)) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(value(r[i]) for i in order)) for r in data)


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def assert_same(df, connection, sql):
    o = connection.sql(sql)
    assert sorted(df.columns) == sorted(o.columns)
    assert rows(df.columns, df.collect()) == rows(o.columns, o.fetchall())
