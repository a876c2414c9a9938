"""Spark rows against DuckDB rows of the same tables."""

import math
import os
from decimal import Decimal

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    return v


def duck_rows(sql: str, columns: list[str]) -> list[tuple]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    return sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)


def spark_rows(df, columns: list[str]) -> list[tuple]:
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def compare(spark, query, sql: str) -> int:
    df = query(spark, DATA)
    columns = sorted(df.columns)
    own, other = spark_rows(df, columns), duck_rows(sql, columns)
    assert own == other
    return len(own)
