"""Holds a query's rows against its SQL in DuckDB, by value and without order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return bytes(v) if isinstance(v, bytearray) else v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)


def rows_of_sql(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    return names, sorted((tuple(plain(v) for v in r) for r in rel.select(quoted).fetchall()), key=repr)
