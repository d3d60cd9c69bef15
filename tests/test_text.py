"""Literal cases of the text functions and of chunking, and the folds against a plain model."""

import random

import pytest
from pyspark.sql import functions as F

from dossier_spark.functions import text as X
from dossier_spark.operators import answers as A
from dossier_spark.operators import retrieval as R
from dossier_spark.operators import transcripts as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize("v,want", [("a\r\nb\rc\n", "a\nb\nc"), ("\n\n\n\n", ""), ("a\n\n\n\nb", "a\n\nb"), (None, None)])
def test_newlines(spark, v, want):
    assert one(spark, v, X.normalise_newlines) == want


@pytest.mark.parametrize("v,want", [("n° 756.1234.5678.90 x", "756.1234.5678.90"), ("7561234567890", "756.1234.5678.90"), ("756.1111.2222.33 puis 756.4444.5555.66", "756.1111.2222.33"), ("rien", None), ("756-1234-5678-90", "756.1234.5678.90"), ("756 12 34 56 78 90", "756.1234.5678.90"), ("756  1234567890", None), ("756.123", None)])
def test_id_number(spark, v, want):
    assert one(spark, v, X.id_number) == want


def test_tokens(spark):
    got = one(spark, "Le chat est dans la maison d'été", X.tokens)
    assert got == ["chat", "maison", "d'été"]
    assert one(spark, "Le chat", lambda c: X.tokens(c, False)) == ["le", "chat"]


@pytest.mark.parametrize("n,size,overlap", [(0, 1200, 200), (1, 1200, 200), (1200, 1200, 200), (1201, 1200, 200), (2500, 1000, 100), (500, 1000, 0), (5000, 100, 99)])
def test_chunks(spark, n, size, overlap):
    text = "".join(random.Random(n).choice("abcdefgh") for _ in range(n))
    want, start = [], 0
    while start < n:
        want.append(text[start : start + size])
        if start + size >= n:
            break
        start += size - overlap
    assert one(spark, text, lambda c: R.chunk_array(c, size, overlap)) == want
    with pytest.raises(ValueError):
        R.chunk_array(F.lit("x"), 10, 10)


@pytest.mark.parametrize("v,want", [("```json\ntest\n```", "test"), ("json: test content", "test content"), ("plain", "plain"), ("```\nx```", "x"), ("jsonify the reply", "jsonify the reply"), ("JSON\n: a", "a"), ("a```b\u200bc", "a b c")])
def test_sanitise(spark, v, want):
    assert one(spark, v, X.sanitise) == want


@pytest.mark.parametrize("v,want", [(" {a", True), ("x [", False), ("see ```", True), ("a Json b", True), ("jsonify", False), ("# title **b**", False)])
def test_marked_up(spark, v, want):
    assert one(spark, v, X.looks_marked_up) == want == A.looks_marked_up(v)


@pytest.mark.parametrize("v,want", [("NAME XX", ["TOKENS"]), ("ressource 12", []), ("(source x", ["SOURCE_REF"]), ("source 3", ["SOURCE_REF"]), ("{{A}} a::b", ["PLACEHOLDER", "MULTI_COLON"]), ("a: b: c", ["MULTI_COLON"]), ("a: b\nc: d", []), ("a:\rb: c", []), ("", [])])
def test_forbidden(spark, v, want):
    assert one(spark, v, X.forbidden_reasons) == want and A.is_forbidden(v) == bool(want)


def test_truncation(spark):
    assert one(spark, "a" * 100, lambda c: X.first_chars(c, 50)) == "a" * 49 + "…"
    assert one(spark, "a\n\n b \nc\nd", lambda c: X.first_lines(c, 2)) == "a\nb"
    assert one(spark, "a\r\rb\u2028c", lambda c: X.first_lines(c, 0)) == "a\nb\nc" and one(spark, "abc", lambda c: X.first_chars(c, 0)) == "abc"


@pytest.mark.parametrize("v,want", [("a1", "A1"), ("C1", None), ("BÔN", "Bon")])
def test_allowed(spark, v, want):
    assert one(spark, v, lambda c: X.allowed_value(c, F.array(F.lit("A1"), F.lit("B1"), F.lit("Bon")))) == want


def test_titles(spark):
    assert one(spark, "  Profession &  Formation :: ", X.title) == "Profession & Formation"
    assert one(spark, "ÉVOLUTION — l'Été (2)", X.robust) == "evolution l ete 2"
    assert one(spark, "LIEU_ET_DATE", X.sentence_query) == "Lieu et date"
    assert one(spark, "Fais le rapport de stage de Anna B", lambda c: X.requested_name(c, "?")) == "Anna B"


def test_override(spark):
    keys = spark.createDataFrame([("nom",), ("AUTRE_CLE",)], "key string")
    specs = spark.createDataFrame([("NOM", "q", "i")], "key string, query string, instructions string")
    got = {r.key: (r.query, r.instructions) for r in A.with_specs(keys, specs).collect()}
    assert got == {"nom": ("q", "i"), "AUTRE_CLE": ("Autre cle", "")}


def model_windows(segments, close=40.0, gap=2.0):
    out, cur = [], []
    for start, _, end, text in sorted(segments, key=lambda s: (s[0], s[1])):
        if not text.strip():
            continue
        if cur and start - cur[-1][1] >= gap:
            out.append(cur)
            cur = []
        had = bool(cur)
        cur = [*cur, (start, end, text.strip())]
        if had and max(e for _, e, _ in cur) - cur[0][0] >= close:
            out.append(cur)
            cur = []
    if cur:
        out.append(cur)
    return [(w[0][0], max(e for _, e, _ in w), " ".join(t for *_, t in w)) for w in out]


def test_pause_is_from_the_last_end(spark):
    rows = [("s", 0, 0.0, 10.0, "a"), ("s", 1, 2.0, 3.0, "b"), ("s", 2, 5.5, 6.0, "c")]
    got = T.windows(spark.createDataFrame(rows, "source_id string, seq int, start double, end double, text string")).orderBy("window_no").collect()
    assert [(w.start, w.end, w.text) for w in got] == [(0.0, 10.0, "a b"), (5.5, 6.0, "c")]


def test_windows(spark):
    r = random.Random(8)
    rows = []
    for source in range(12):
        t = 0.0
        for i in range(60):
            length = r.choice([1.0, 5.0, 9.5, 41.0])
            rows.append((str(source), i, t, t + length, r.choice(["a", "bb", " ", ""]) or ""))
            t += length + r.choice([0.0, 0.5, 2.0, -3.0])
    got = {}
    for w in T.windows(spark.createDataFrame(rows, "source_id string, seq int, start double, end double, text string")).orderBy("source_id", "window_no").collect():
        got.setdefault(w.source_id, []).append((w.start, w.end, w.text))
    for source in {x[0] for x in rows}:
        assert got.get(source, []) == model_windows([x[2:3] + x[1:2] + x[3:] for x in rows if x[0] == source])
