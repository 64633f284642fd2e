"""Row-for-row comparison of a Spark query with its SQL twin in DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf: str):
    db = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        if os.path.exists(path):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db.sql(sql).df()


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind in "iuf":
            frame[c] = frame[c].astype(float).round(9)
        else:
            frame[c] = frame[c].map(lambda v: str(v).removesuffix(" 00:00:00"))  # a date at either engine
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def assert_same(df, sql: str, sf: str) -> None:
    got, want = normal(df.toPandas()), normal(oracle(sql, sf))
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.astype(str).equals(want.astype(str)), got.compare(want).head()
