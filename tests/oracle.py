"""Compares a Spark result with DuckDB's, whatever the order of rows and columns."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return str(round(float(v), 5))
    return str(v)


def normal(columns, tuples):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(t[i]) for i in at) for t in tuples)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = con.sql(sql)
    return normal(r.columns, r.fetchall())


def spark_rows(df):
    return normal(df.columns, df.collect())
