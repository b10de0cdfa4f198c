"""Comparison of a query with its SQL on the smallest tables."""

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _text(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


def same(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = query(spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = con.sql(sql).df().astype(object)
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows_of(list(want.columns), list(want.itertuples(index=False)))
