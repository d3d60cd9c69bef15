import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb

from dossier_spark.llm import mixing as M


def place(*parts):
    return int(hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def doc_place(d, text):
    return place(M.SEED, "doc", "null" if d is None else d, "null" if text is None else hashlib.md5(text.encode()).hexdigest())


def brute(rows, max_repeat=2.0):
    n = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for *_, t in rows]
    total = Counter()
    for (_, s, _), k in zip(rows, n):
        total[s or ""] += k
    live = {s: k for s, k in total.items() if k}
    a, low = 1.0, 0.0
    for _ in range(48):
        mid = (low + a) / 2
        if (max(live.values()) / min(live.values())) ** (1 - mid) <= max_repeat:
            a = mid
        else:
            low = mid
    scale = max(k / k**a for k in live.values())
    out = []
    for s in total:
        target = max(total[s], round(total[s] ** a * scale)) if total[s] else 0
        blocks = max(1, -(-total[s] // M.BLOCK_WORDS))
        by = defaultdict(list)
        for (d, t, x), k in zip(rows, n):
            if (t or "") == s:
                by[place(M.SEED, "block", "null" if d is None else d) % blocks].append((d, k, doc_place(d, x)))
        whole = target // total[s] if total[s] else 1
        rest = target - whole * total[s] if total[s] else 0
        for e in range(whole):
            out += [(d, s, k, b, e, place(M.SEED, "pass", s, e, b)) for b in by for d, k, _ in by[b]]
        # the last pass stops at the budget; the block that crosses it is taken document by document
        for p, b in sorted((place(M.SEED, "pass", s, whole, b), b) for b in by):
            if rest <= 0:
                break
            words = Counter()
            for _, k, at in by[b]:
                words[at] += k
            used, stop = 0, 1 << 32
            for at in sorted(words):
                used += words[at]
                if used > rest:
                    stop = at
                    break
            out += [(d, s, k, b, whole, p) for d, k, at in by[b] if at < stop]
            rest = 0 if stop < 1 << 32 else rest - used
    return sorted(out, key=str)


def run(spark, rows, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK_WORDS", block)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = M.mix(df).select("doc_id", "mix_source", "mix_words", "mix_block", "mix_epoch", "mix_place").collect()
    return sorted(map(tuple, got), key=str)


def test_matches_brute_force(spark, monkeypatch):
    rows = [(i, "abcde"[min(4, i % 7)], "w " * (i % 13)) for i in range(700)] + [(700 + i, "small", "x y z") for i in range(9)]
    rows += [(800, None, "null source here"), (801, "empty", ""), (802, "empty", None), (None, "a", "no id"), (3, "d", rows[3][2]), (3, "d", rows[3][2])]
    assert run(spark, rows, monkeypatch, 20) == brute(rows)


def test_weights(spark):
    stats = spark.createDataFrame([("a", 1000, 1), ("b", 100, 1), ("c", 10, 1), ("z", 0, 1)], "source string, words long, docs long")
    a = M.exponent(stats)
    assert abs((100.0 ** (1 - a)) - 2) < 1e-6
    b = M.exponent(stats, entropy=1.0)
    p = [k**b for k in (1000, 100, 10)]
    assert abs(-sum(x / sum(p) * math.log(x / sum(p)) for x in p) - 1.0) < 1e-6
    w = {r.source: r for r in M.weigh(stats, a).collect()}
    assert w["a"].target == 1000 and w["c"].target == 20 and abs(sum(r.weight for r in w.values()) - 1) < 1e-9
    assert M.exponent(stats.limit(0)) == 1.0


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    got = sorted(map(tuple, M.op5_source_mixing(spark, sf).collect()), key=str)
    assert got == brute(rows)
    empty = spark.createDataFrame([], "doc_id long, source string, text string, mix_words int")
    assert M.mix(empty).count() == 0
    odd = spark.createDataFrame([(1, "a", "x y", 1, 2, 3, "n", 9)], "doc_id long, source string, text string, blocks int, passes int, words int, mix_note string, mix_words int")
    out = M.mix(odd)
    assert out.select("blocks", "passes", "words", "mix_note", "mix_words").first() == (1, 2, 3, "n", 2) and out.columns.count("mix_words") == 1


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(M.ORACLE_SQL["op5_source_mixing"])
    df = M.op5_source_mixing(spark, sf)
    assert sorted(df.select(*rel.columns).collect()) == sorted(rel.fetchall()) and sorted(rel.columns) == sorted(df.columns)
