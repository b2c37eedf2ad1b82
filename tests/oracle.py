"""Compares registered queries with their DuckDB SQL."""

import datetime
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def compare(spark, sf_dir, query, sql, connection):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    rel = connection.sql(sql)
    names = rel.columns
    theirs = sorted(repr(tuple(norm(r[names.index(c)]) for c in columns)) for r in rel.fetchall())
    assert sorted(names) == columns
    assert ours == theirs
