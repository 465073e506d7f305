"""Where the queries are kept, by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def dealt(df, key):
    """Rows dealt by a key over a number of partitions that adaptive execution keeps: what follows costs time, not bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def read(spark, sf_dir, name, *cols):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df
