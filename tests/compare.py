"""Rows of Spark and DuckDB in one form, without order."""

import math

import duckdb
import numpy as np

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canon(x):
    if x is None:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 1e15:
        return int(x)
    if isinstance(x, (list, tuple)):
        return tuple(canon(y) for y in x)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(canon(r[k]) for k in order) for r in data), key=repr)


def of_spark(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def of_duckdb(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    return sorted(found.columns), rows(found.columns, found.fetchall())
