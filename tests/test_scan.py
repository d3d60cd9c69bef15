"""Client search against a plain version; numbering and readiness."""

import unicodedata
from difflib import SequenceMatcher

import pytest

from dossier_spark.operators import scan as S
from dossier_spark.operators.ordering import numbered

NAMES = ["ARIFI Élodie", "Arifi", "Dupont", "Dupont Jean", "jean dupont-martin", "Martin  Anna", "", "Zoé", "Elodie ARIFI Costa", "DUPOND Jean"]
ASKED = ["arifi", "dupont jean", "élodie arifi", "jean", "xyz", "martin anna"]


def plain(q, t):
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn").lower()
    q, t = fold(q), fold(t)
    s = SequenceMatcher(None, q, t).ratio() + 0.3 * (q in t) + 0.2 * t.startswith(q)
    words = set(q.split())
    return min(1.0, s + 0.3 * (bool(words) and words <= set(t.split())))


@pytest.mark.parametrize("least", [0.0, 0.3, 0.9])
def test_scores(spark, least):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = {(r.asked, r.folder): r.score for r in S.find_clients(ASKED, df, least=least, n=None).collect()}
    want = {(q, t): plain(q, t) for q in ASKED for t in NAMES if plain(q, t) >= least}
    assert got == pytest.approx(want)
    assert round(plain("dupont jean", "Dupont"), 2) == 0.71


def test_best_and_exact(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = {r.asked: (r.folder, r.matches) for r in S.find_client(["arifi", "dupt jn", "zoe"], df, exact=True).collect()}
    assert got["zoe"] == ("Zoé", 1) and got["arifi"][0] in ("ARIFI Élodie", "Arifi")
    assert got.get("dupt jn", (None, 0))[0] is None
    first = {r.asked: r.folder for r in S.find_clients(["dupont jean"], df, n=1).collect()}
    assert first == {"dupont jean": "Dupont Jean"}


def test_numbered(spark):
    rows = [("a" if i % 3 else "b", (i * 37) % 101, i) for i in range(300)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, x int, y int")
    got = {(r.k, r.x, r.y): r.place for r in numbered(df, "k", ["x", "y"], ranges=7).collect() if r.k}
    for k in "ab":
        for n, (_, x, y) in enumerate(sorted(r for r in rows if r[0] == k), 1):
            assert got[k, x, y] == n


def test_scan_of_small_folders(spark):
    f = [("c", "06 Rapport final", "rapport_final.docx", ".docx", 100), ("c", "", "notes.txt", ".txt", 50), ("c", "01 Dossier personnel", "x.pdf", ".pdf", 5), ("d", "", "bilan.docx", ".docx", 7), ("e", "", "photo.jpg", ".jpg", 1)]
    df = spark.createDataFrame([(c, d, n, s, b, 1, f"{c}/{d}/{n}") for c, d, n, s, b in f], "client_id string, folder string, name string, suffix string, size_bytes long, mtime long, path string")
    got = {r.client_id: r for r in S.scan(df, spark).collect()}
    assert (got["c"].n_sources, got["c"].ready, got["c"].strategy, got["c"].quality) == (2, True, "06_rapport_final", "medium")
    # the only document is the reference document and so no source
    assert (got["d"].n_sources, got["d"].ready, got["d"].strategy) == (0, False, "recursive_scan") and got["e"].gold is None
