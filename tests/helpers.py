"""Rows compared as the driver compares them: by column name, in any order."""

import math
import os

SMALL = "/root/testdata/sf0.001"


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()], key=str)


def duck_rows(sql, folder):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted([tuple(norm(r[i]) for i in at) for r in got.fetchall()], key=str)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
