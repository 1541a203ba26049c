"""Holding a query against its SQL in DuckDB."""

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else repr(v) for v in r) for r in rows)


def assert_same(spark, query, sql):
    found = query(spark, SF)
    columns = sorted(found.columns)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    stated = db.sql(sql)
    assert sorted(stated.columns) == columns
    assert rounded(tuple(r) for r in found.select(*columns).collect()) == rounded(stated.select(*[f'"{c}"' for c in columns]).fetchall())
