"""Every registered query of the library proper against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from dossier_spark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(x) for x in r))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name not in registry.oracle_sql():
        assert df.columns
        return
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = rows_of(rel.columns, rel.fetchall())
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[:2]
