"""Rows of a query and of its SQL in DuckDB, in a form that can be compared."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def both(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    rows = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    found = connect(sf_dir).sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    return rows, sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())
