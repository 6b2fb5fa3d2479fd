"""Comparison of query results with SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return str(v) if v is not None else None


def same(spark, sf_dir, f, sql):
    df = f(spark, sf_dir)
    r = connect(sf_dir).execute(sql)
    names, rows = [d[0] for d in r.description], r.fetchall()
    assert sorted(df.columns) == sorted(names)
    k = sorted(names)
    a = sorted(repr(tuple(norm(x[c]) for c in k)) for x in df.collect())
    b = sorted(repr(tuple(norm(x[names.index(c)]) for c in k)) for x in rows)
    assert a == b
    return len(a)
