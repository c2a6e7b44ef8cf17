"""Compares a query's rows with those of its SQL, whatever their order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    return sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=repr)


def check(spark, con, query, sql, folder):
    df = query(spark, folder)
    relation = con.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    want = rows_of(relation.columns, [dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()])
    assert rows_of(df.columns, [r.asDict() for r in df.collect()]) == want
    return len(want)
