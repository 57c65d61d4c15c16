"""Spark against DuckDB on the same Parquet tables."""

import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _row(values):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in values)


def both(spark, con, run, sql, sf_dir):
    """Sorted rows of both, with columns in the order of their names."""
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    mine = [_row(r[c] for c in columns) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = [_row(r[i] for i in at) for r in result.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted(mine, key=key), sorted(theirs, key=key)
