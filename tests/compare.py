"""Comparison of query results with DuckDB on the same tables."""

import glob
import math
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.item() if hasattr(v, "item") else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(norm(r[i])) for i in order) for r in data)


def of_sql(con, text):
    c = con.execute(text)
    return rows([x[0] for x in c.description], c.fetchall())


def of_df(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
