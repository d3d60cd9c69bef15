import math
import re
import zlib

import numpy as np

from dossier_spark.llm import toxicity as X


def test_nnpu_recovers_the_rule():
    r = np.random.default_rng(1)
    n = 3000
    truth = r.random(n) < 0.2
    x = (r.random((n, 30)) < 0.1).astype(np.float32)
    x[:, 0] = truth & (r.random(n) < 0.95)
    known = truth & (r.random(n) < 0.4)
    rest = ~known
    w, b = X.fit_nnpu(np.concatenate([x[known], x]), np.r_[np.ones(known.sum(), bool), np.zeros(n, bool)], 0.2)
    guess = x[rest] @ w + b > 0
    assert (guess == (truth[rest])).mean() > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(i, f"{'good' if i % 5 else 'vile'} words {chr(97 + i % 26)}q{chr(97 + i // 26)}", "x") for i in range(200)] + [(None, "vile", "y"), (900, None, "z"), (901, "", "z"), (901, "", "z"), (902, "w " * 40_000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 200, 2)] + [(None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    model = X.train(docs, labels)
    got = X.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 205 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int("vile" in (r.text or "")) for r in rows)
    assert X.score(docs.limit(0), model).count() == 0
    none = X.train(docs, labels.filter("toxic = 0"))
    assert all(r.predicted == 0 for r in X.score(docs, none).collect())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = X.op9_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.93
    hit, said, toxic = sum(p and t for p, t in held), sum(p for p, _ in held), sum(t for _, t in held)
    assert toxic >= 100 and hit / toxic > 0.8 and hit / said > 0.9  # 101 of 120, of 104 said


def test_scores_match_slow(spark, sf):
    """Every score by plain sums over the document's words and word beginnings, on the whole table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    m = X.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    weight = dict(zip(m.names, m.weights.tolist(), strict=True))
    for r in X.score(docs, m).collect():
        held = set()
        for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            held |= {w + "$"} | {w[:n] for n in range(3, 9) if n <= len(w)}
        z = m.bias + math.fsum(weight[f] for f in held if f in weight)
        assert abs(r.score - 1 / (1 + math.exp(-max(-50, min(50, z))))) < 1e-9 and r.predicted == int(r.score >= 0.3)


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    """An id of 3,000 texts takes no more places than the sample has."""
    rows = [(4, f"vile text {i}") for i in range(3000)] + [(i, f"good text {i}") for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1)] + [(i, 0) for i in range(10, 400)], "doc_id long, toxic int")
    sizes = []
    fit = X.fit_nnpu
    monkeypatch.setattr(X, "fit_nnpu", lambda x, positive, prior: (sizes.append((int(positive.sum()), int((~positive).sum()))), fit(x, positive, prior))[1])
    X.train(docs, labels, positives=10, unlabelled=20)
    assert sizes == [(10, 20)]
