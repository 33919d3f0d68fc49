"""Spark results held against DuckDB SQL."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def value(v):
    if v is None or v != v:
        return None
    return v.isoformat() if hasattr(v, "isoformat") else float(v) if isinstance(v, float) else v


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(value(r[i]) for i in order) for r in rows)


def same(spark_df, con, sql: str) -> None:
    found = con.sql(sql)
    assert sorted(spark_df.columns) == sorted(found.columns)
    assert rows_of(spark_df.columns, spark_df.collect()) == rows_of(found.columns, found.fetchall())
