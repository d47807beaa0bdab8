"""Rows of a Spark query and of its SQL in DuckDB, in one form."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float) and x == int(x) and abs(x) < 1e15:
        return str(int(x))
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(value(r[i])) for i in order) for r in data)


def of_spark(df):
    return rows(df.columns, df.collect())


def of_duck(connection, sql):
    found = connection.sql(sql)
    return rows(found.columns, found.fetchall())
