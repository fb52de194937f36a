"""Rows of a Spark query against those of SQL on the same tables."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else repr(round(float(v), 5) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ")
    return str(v)


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    found = con.sql(sql)
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [list(found.columns).index(c) for c in columns]
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:2], list((theirs - ours).items())[:2])
