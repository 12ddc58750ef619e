"""Comparing a query with its SQL on the same Parquet files."""

import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(folder):
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return c


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, int):
        return str(x)  # ids, counts and times are equal or they aren't
    if isinstance(x, (float, Decimal)):
        near = float(x) if float(x).is_integer() else float(f"{float(x):.6e}")
        return str(int(near)) if near.is_integer() else repr(near)
    return repr(x)


def normal(columns, table):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(_plain(r[k]) for k in order) for r in table)


def same(spark_df, connection, sql):
    got = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = connection.execute(sql)
    want = normal([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
