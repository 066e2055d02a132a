"""Rows as comparable values, and the SQL side of a query."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    return x


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(value(x) for x in r) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)


def duck_rows(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    return names, sorted((tuple(value(x) for x in r) for r in rel.select(", ".join(f'"{c}"' for c in names)).fetchall()), key=repr)
