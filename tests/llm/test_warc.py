import base64
import hashlib

import duckdb
import pytest

from dossier_spark.llm import warc as W


def brute(rows):
    best = {}
    for pid, _, html in rows:
        best[html or ""] = max([x for x in (pid, best.get(html or "")) if x is not None], default=None)
    out = []
    for pid, _, html in rows:
        raw, top = (html or "").encode(), best[html or ""]
        kind = "response" if pid == top else "revisit"
        out.append((pid, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if kind == "response" else top))
    return sorted(out, key=str)


COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_small(spark):
    rows = [(1, "http://a/x y\n", "<p>é"), (2, None, "<p>é"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 300_000), (6, "u", "own"), (6, "u", "own"), (None, "n", "nul"), (None, "n", "<p>é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = W.write_archives(df)
    got = W.read_archives(archives).collect()
    assert sorted((tuple(r[c] for c in COLS) for r in got), key=str) == brute(rows)
    assert {r.payload for r in got if r.page_id == 2} == {"<p>é".encode()}
    assert [r.url for r in got if r.page_id == 1] == ["http://a/x%20y%0A"]
    assert W.write_archives(df.limit(0)).count() == 0


def test_heavy_payloads(spark, monkeypatch):
    monkeypatch.setattr(W, "HEAVY", 3)
    rows = [(i, "u", None if i % 2 else f"page {i % 8}") for i in range(30)] + [(None, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((tuple(r[c] for c in COLS) for r in W.read_archives(W.write_archives(df)).collect()), key=str) == brute(rows)


def test_damage():
    rs = [W.record(i, "u", b"x" * i, i) for i in range(5)]
    a = W.write_archive(rs)
    assert list(W.frames(a)) == rs
    for bad in (a[:-3], b"\0" * 20, a[:4], a[:-8] + b"\0" * 8):
        with pytest.raises(W.WarcError):
            list(map(W.parse, W.frames(bad)))
    for bad in (rs[3].replace(b"xxx", b"xyx"), rs[3].replace(b"Content-Length", b"Content-Size"), rs[3] + b"z", rs[3].replace(b"WARC/1.1", b"WARC/9"), rs[3].replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(W.WarcError):
            W.parse(bad)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r[c] for c in COLS) for r in W.op10_warc(spark, sf).collect()), key=str) == brute(rows)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    rel = con.sql(W.ORACLE_SQL["op10_warc"])
    df = W.op10_warc(spark, sf)
    assert sorted(rel.columns) == sorted(df.columns) and sorted(map(tuple, df.collect())) == sorted(rel.select(*df.columns).fetchall())
