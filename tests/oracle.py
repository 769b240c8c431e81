"""Rows of Spark and DuckDB in one form."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def database(sf=SF):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if glob.glob(path + '/*') else path}'")
    return con


def canonical(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA:
            return None
        if isinstance(v, float):
            return None if v != v else round(v, 6) + 0.0
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return tuple(map(one, v))
        return one(v) if isinstance(v, float) else v

    columns = sorted(df.columns)
    return columns, sorted((tuple(one(v) for v in r) for r in df[columns].itertuples(index=False, name=None)), key=repr)
