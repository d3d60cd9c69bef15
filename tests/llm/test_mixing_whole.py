"""Budgets are met to within one document, also by sources of a single block."""

import hashlib
from collections import Counter, defaultdict

import pytest

from dossier_spark.llm import mixing as M

from .test_mixing import place


def doc_place(d, t):
    return place(M.SEED, "doc", "null" if d is None else d, "null" if t is None else hashlib.md5(t.encode()).hexdigest())


def brute(rows, targets):
    """(doc_id, source, words, block, epoch, place) of whole passes and of the last one, cut document by document."""
    n = [len((t or "").split()) for *_, t in rows]
    out = []
    for s, target in targets.items():
        mine = [(d, t, k) for (d, source, t), k in zip(rows, n) if (source or "") == s]
        total = sum(k for *_, k in mine)
        by = defaultdict(list)
        for d, t, k in mine:
            by[place(M.SEED, "block", "null" if d is None else d) % max(1, -(-total // M.BLOCK_WORDS))].append((d, t, k))
        whole = target // total if total else 1
        for e in range(whole):
            out += [(d, s, k, b, e, place(M.SEED, "pass", s, e, b)) for b in by for d, t, k in by[b]]
        rest = target - whole * total if total else 0
        for p, b in sorted((place(M.SEED, "pass", s, whole, b), b) for b in by):
            if rest <= 0:
                break
            words = Counter()
            for d, t, k in by[b]:
                words[doc_place(d, t)] += k
            used, stop = 0, 1 << 32
            for at in sorted(words):
                used += words[at]
                if used > rest:
                    stop = at
                    break
            out += [(d, s, k, b, whole, p) for d, t, k in by[b] if doc_place(d, t) < stop]
            rest = 0 if stop < 1 << 32 else rest - used
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [None, 60])
def test_small_sources_meet_their_targets(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(M, "BLOCK_WORDS", block)
    rows = [(i, "hot", "w " * (i % 13)) for i in range(800)] + [(1000 + i, "mid", "x " * (i % 7 + 1)) for i in range(60)] + [(2000 + i, "small", "y z " * (i % 3 + 1)) for i in range(40)]
    rows += [(3000, None, "null source here"), (3001, None, "one more"), (None, "mid", "no id"), (None, "mid", "nor this one"), (1003, "mid", rows[803][2]), (3002, "empty", ""), (3003, "empty", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    stats = M.totals(df, "text", "source")
    plan = {r.source: r for r in M.weigh(stats, M.exponent(stats)).collect()}
    got = sorted(map(tuple, M.mix(df).select("doc_id", "mix_source", "mix_words", "mix_block", "mix_epoch", "mix_place").collect()), key=str)
    assert got == brute(rows, {s: r.target for s, r in plan.items()})
    used, longest = Counter(), Counter()
    for d, s, k, *_ in got:
        used[s] += k
        longest[s] = max(longest[s], 2 * k if d == 1003 else k)
    assert 1 < plan["mid"].repeats < 2 and 1 < plan["small"].repeats < 2
    for s, r in plan.items():
        assert r.target - longest[s] <= used[s] <= r.target


def test_table_meets_its_targets(spark, sf):
    """Of the shared table, whose sources are smaller than a block."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stats = M.totals(docs, "text", "source")
    plan = M.weigh(stats, M.exponent(stats)).collect()
    got = M.op5_source_mixing(spark, sf).collect()
    used, longest = Counter(), Counter()
    for r in got:
        used[r.source] += r.n_words
        longest[r.source] = max(longest[r.source], r.n_words)
    assert any(r.repeats > 1 for r in plan)
    for r in plan:
        assert r.target - longest[r.source] <= used[r.source] <= r.target
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()}
