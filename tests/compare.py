"""Comparison of a query with its SQL on the same Parquet tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


def assert_same(spark, sf_dir: str, query, sql: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
