"""The registered BM25 queries against a plain version that scores every word of an item."""

import math
from collections import Counter, defaultdict

import pytest

from dossier_spark.plans import retrieval_queries as Q

EARLY = "alpha bravo carol delta echo fox golf hotel"
ITEMS = [(1, f"{EARLY} india juliet kilo kilo"), (2, f"{EARLY} lima"), (3, "mike")]
TEXTS = [(1, "alpha zulu", "s1"), (2, "india juliet kilo yankee", "s1"), (3, "lima kilo kilo bravo", "s1"), (4, "kilo", "s2"), (5, "zulu mike yankee", "s2"), (6, "xray", "s2")]


@pytest.fixture
def small(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def brute():
    """{(client, query, path): score} of the scores above 0."""
    by = defaultdict(list)
    for d, t, s in TEXTS:
        by[s].append((f"{s}/doc_{d}.txt", t.split()))
    out = {}
    for s, docs in by.items():
        mean, df = sum(len(w) for _, w in docs) / len(docs), Counter(t for _, w in docs for t in set(w))
        for q, text in ITEMS:
            for path, w in docs:
                tf = Counter(w)
                score = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in text.split() if tf[t])
                if score > 0:
                    out[s, q, path] = score
    return out


def test_whole_items_are_scored(spark, small):
    want = brute()
    got = {(r.client_id, r.query_id, r.path): r.score for r in Q.scores(spark, small).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    assert ("s2", 1, "s2/doc_4.txt") in got  # shares only the eleventh word
    top = defaultdict(list)
    for r in Q.top_k(spark, small).orderBy("rank").collect():
        top[r.client_id, r.query_id].append(r.path)
    for k in {k[:2] for k in want}:
        assert top[k] == [p for _, p in sorted((-v, p) for (c, q, p), v in want.items() if (c, q) == k)]


def test_all_terms_join(spark, small):
    got = {(r.client_id, r.query_id, r.term): (r.qtf, r.df) for r in Q.query_term_join(spark, small).collect()}
    assert got["s1", 1, "kilo"] == (2, 2) and got["s2", 1, "kilo"] == (2, 1) and got["s1", 2, "lima"] == (1, 1)
