"""Rows of a query against rows of its SQL, as sorted text."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(repr(tuple(r)) for r in frame.itertuples(index=False, name=None))


def same(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    left, right = query(spark, sf).toPandas(), con.execute(sql).df()
    assert sorted(left.columns) == sorted(right.columns)
    for c in left.columns:
        if str(left[c].dtype).startswith("datetime"):
            left[c], right[c] = left[c].astype(str), right[c].astype(str)
    assert rows(left) == rows(right)
