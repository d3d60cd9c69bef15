import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from dossier_spark.llm import suffix_dedup as S


def brute(rows, window=200):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for (doc, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(r), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = S.remove_repeated_bytes(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted(map(tuple, got), key=str)


def planted(seed, n=60):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh é日\n ") for _ in range(n))
    rows = [(i, text(r.randrange(0, 700))) for i in range(n)]
    for size in (150, 170, 180, 190, 198, 199, 200, 201, 230, 320, 900):
        p = text(size)
        rows += [(1000 + 10 * size + i, text(r.randrange(300)) + p + text(r.randrange(300)) + (p[: size // 2] if i else "")) for i in range(3)]
    base = text(2500)
    for i in range(12):  # near copies
        t = list(base)
        for _ in range(r.randrange(12)):
            t[r.randrange(len(t))] = "Z"
        rows.append((50_000 + i, "".join(t)))
    line = text(120)
    rows += [(60_000 + i, text(90) + line + text(90)) for i in range(40)]  # a common line, too short to go
    rows += [(70_000, "x" * 900), (70_001, "y" * 200), (70_002, "y" * 201), (70_003, "y" * 199), (70_004, "ab" * 400), (70_005, "z" * 150 + "x" * 190)]
    rows += [(None, rows[3][1]), (7, None), (8, ""), (8, ""), (None, base), (9, rows[9][1]), (9, text(500))]
    return rows


@pytest.mark.parametrize("options", [{}, {"part_bytes": 3000, "batches": 7}, {"hot": 4, "part_bytes": 9000, "batches": 1}, {"hot": 0, "batches": 3}])
def test_brute_force(spark, options):
    rows = planted(1)
    assert run(spark, rows, **options) == brute(rows)


def test_other_windows(spark):
    rows = planted(5, 20)
    assert run(spark, rows, window=60, depth=16) == brute(rows, 60)


def test_long_text_in_pieces(spark, monkeypatch):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p, long = text(300), text(9000)
    rows = [(1, text(3000) + p + text(2000) + p + long), (2, long[1000:5000] + text(50)), (3, p)]
    offs = np.array([0, 5, len(rows[0][1])])
    monkeypatch.setattr(S, "PIECE", 1000)
    cuts = list(S.pieces(offs, 200))
    starts = [i for a, z, o in cuts for x, y in zip(o[:-1], o[1:]) for i in range(x, y - 199)]
    assert starts == list(range(5, offs[2] - 199)) and len(cuts) > 5
    assert run(spark, rows) == brute(rows)


def test_sorted_suffixes():
    r = random.Random(3)
    b = np.frombuffer(bytes(r.choice(b"ab") for _ in range(3000)), np.uint8)
    at = np.arange(0, 2900, 3)
    words = S.suffix_words(b, at, 64)
    order, new = S.suffix_order(words)
    heads = [bytes(b[i : i + 64]) for i in at]
    assert [heads[i] for i in order] == sorted(heads)
    assert list(new) == [i == 0 or heads[order[i]] != heads[order[i - 1]] for i in range(len(order))]


def test_same_windows_choose_alike():
    r = random.Random(8)
    p = bytes(r.choice(b"abc") for _ in range(260))
    b = np.frombuffer(bytes(r.choice(b"abc") for _ in range(777)) + p + b"q" * 40 + p, np.uint8)
    starts, place = S.chosen(b, np.array([0, len(b)]), 200, 64)
    assert (place - starts >= 0).all() and (place - starts <= 136).all()
    first, again = 777 + np.arange(61), 777 + 300 + np.arange(61)
    assert (place[first] - first == place[again] - again).all()


def test_levels_merge_like_a_counter(spark):
    family = S.Family(spark, 2)
    df = spark.createDataFrame([(0, i, bytes([65 + i]) * 300) for i in range(5)], "home int, row int, raw binary")
    held = []
    for i in range(5):
        family.add(df.filter(f"row = {i}"))
        held.append(sorted(family.levels))
    assert held == [[0], [1], [0, 1], [2], [0, 2]]
    family.drop()


def test_empty_and_clashing(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a" * 300, 5, 7, None, 3)], "doc_id long, text string, n_bytes int, home int, raw string, filler int")
    got = S.remove_repeated_bytes(df).collect()[0]
    assert (got.n_bytes, got.n_removed, got.n_spans, got.kept, got.home, got.raw, got.filler) == (300, 300, 1, b"", 7, None, 3)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, S.op13_suffix_dedup(spark, sf).collect()), key=str) == brute(rows)
