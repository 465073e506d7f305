"""Rows of a query and of its SQL in DuckDB, in one form."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(v)


def duck(sql, sf=SF):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    r = con.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def compare(spark, query, sql, sf=SF):
    df = query(spark, sf)
    cols = sorted(df.columns)
    names, rows = duck(sql, sf)
    assert cols == sorted(names)
    at = [names.index(c) for c in cols]
    got = sorted("|".join(map(_plain, r)) for r in df.select(cols).collect())
    assert got == sorted("|".join(_plain(r[i]) for i in at) for r in rows)
