import math
import zlib
from collections import Counter

import numpy as np

from dossier_spark.llm import language_id as L


def test_counts_match_slow():
    text = "Été, 12 ab\n" * 3
    raw = (" " + text.lower() + " ").encode()
    raw = bytes(b if 97 <= b <= 122 or b >= 0x80 else 32 for b in raw)
    want = Counter()
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            g = raw[i : i + n]
            if g.strip():
                h = (int.from_bytes(g, "big") * 0x9E3779B1 + 0x85EBCA6B * n) & 0xFFFFFFFF
                want[(h >> 16) * L.BINS >> 16] += 1
    got = L.counts(text)
    assert {i: int(got[i]) for i in np.flatnonzero(got)} == dict(want)
    long = "abc déf " * 100_000
    assert abs(int(L.counts(long).sum()) - 100_000 * int(L.counts("abc déf ").sum())) < 400_000


def test_edges(spark):
    rows = [(i, "the cat sat on the mat" if i % 2 else "der hund liegt auf der matte", "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 %%", "de"), (103, "der der", None), (None, "the the", None), (1, rows[1][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = L.train(df)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in L.predict(df, m).collect()}
    assert got[100, None] == got[101, ""] == got[102, "12 %%"] == ("und", 0.0)
    assert got[103, "der der"][0] == "de" and got[None, "the the"][0] == "en"
    assert L.predict(df.limit(0), m).count() == 0
    strict = L.Model(m.languages, m.centroids, m.idf, 0.99)
    assert strict.predict("zzz qqq")[0] == "und"
    empty = L.train(df.filter("lang = 'xx'"))
    assert empty.predict("the") == ("und", 0.0)


def slow_vector(text, idf):
    """The vector of a text, n-gram by n-gram."""
    raw = bytes(b if 97 <= b <= 122 or b >= 0x80 else 32 for b in (" " + text.lower() + " ").encode())
    c = Counter()
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            if raw[i : i + n].strip():
                c[((int.from_bytes(raw[i : i + n], "big") * 0x9E3779B1 + 0x85EBCA6B * n & 0xFFFFFFFF) >> 16) * L.BINS >> 16] += 1
    v = {k: math.log1p(m) * float(idf[k]) for k, m in c.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()}


def test_predictions_match_slow(spark, sf):
    """The nearest centroid by plain sums, on the whole table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    m = L.train(docs)
    for r in L.predict(docs, m).collect():
        if not r.text or not any(ch.isalpha() for ch in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = slow_vector(r.text, m.idf)
        cosines = [sum(x * float(c[k]) for k, x in v.items()) for c in m.centroids]
        assert abs(max(cosines) - r.score) < 1e-4
        assert max(x for x, lang in zip(cosines, m.languages) if lang == r.lang_pred) > max(cosines) - 1e-4


def test_sample(spark, monkeypatch):
    """The rows of least hash, whether thinned or not, equal rows once; a language of one row that repeats is learned."""
    rows = [(i, f"wort {i} und", "de") for i in range(3000)] + [(1, "the same row", "en")] * 400 + [(i, f"le mot {i}", "fr") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    thin = L.train(df, per_language=20)
    monkeypatch.setattr(L, "THINNED", 1000)
    whole = L.train(df, per_language=20)
    assert thin.languages == whole.languages and set(thin.languages) == {"de", "en", "fr"} and np.allclose(thin.centroids, whole.centroids) and np.allclose(thin.idf, whole.idf)


def test_many_languages_and_clashing_names(spark):
    """More than a thousand languages, each of a word of its own; columns named like outputs and inner ones."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i * 10 + j, f"{word(i)} {word(i)}", f"l{i:04d}", "old", 5.0, 7) for i in range(1100) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, n int")
    m = L.train(df)
    assert len(set(m.languages)) > 1000
    got = L.predict(df.filter("doc_id < 200"), m)
    assert got.columns == ["doc_id", "text", "lang", "n", "lang_pred", "score"] and all(r.n == 7 for r in got.collect())


def test_hot_row_among_others(spark):
    """A row that repeats most of its language does not take the places of the others."""
    rows = [(1, "same same", "de")] * 6000 + [(i, f"wort {i}", "de") for i in range(10, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    kept = []
    fit = L._fit
    try:
        L._fit = lambda v, *a: (kept.append(v.count()), fit(v, *a))[1]
        L.train(df, per_language=30)
    finally:
        L._fit = fit
    assert kept == [30]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = L.op7_language_id(spark, sf).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    print(sum(held) / len(held))
    assert sum(held) / len(held) > 0.97
