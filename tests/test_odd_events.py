"""Queries over timed segments against their SQL, on events with nulls, equal times and times before 1970."""

import datetime as dt
import random

import duckdb
import pytest

from dossier_spark.plans import registry

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def plain(n, users=3, year=2024):
    r = random.Random(n)
    return [[i, dt.datetime(year, 1, 1) + dt.timedelta(seconds=41 * i + r.random()), i % users, r.choice(["view", "click"]), r.choice([0.0, 4.0, 29.27, 122.79]), "{}"] for i in range(n)]


def emptied(column, step=7):
    return [[None if j == column and i % step == 3 else v for j, v in enumerate(row)] for i, row in enumerate(plain(400))]


ODD = {
    "rows of nulls": plain(300) + [[None] * 6] * 5,
    "no event_id": emptied(0),
    "no ts": emptied(1),
    "no user_id": emptied(2),
    "no event_type": emptied(3),
    "no value": emptied(4),
    "before 1970": plain(300, year=1969) + [[1000 + i, dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=17_000 * (i - 20), microseconds=-500), 0, "view", 1.5, "{}"] for i in range(40)],
    "twice": plain(200) * 2,
}


@pytest.mark.parametrize("odd", ODD)
@pytest.mark.parametrize("name", ["N29", "W8", "S16"])
def test_odd_events(spark, tmp_path, name, odd):
    spark.createDataFrame(ODD[odd], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == sorted(con.sql(registry.oracle_sql()[name]).select(*[f'"{c}"' for c in df.columns]).fetchall(), key=str)
