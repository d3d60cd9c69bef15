import random
import re

import pytest
from pyspark.sql import functions as F

from dossier_spark.llm import near_dedup as N


def sets_of(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    sets = sets_of(rows)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for i, s in enumerate(sets):
        from collections import Counter

        for k, both in Counter(m for x in s for m in by[x] if m < i).items():
            if 100 * both >= 75 * len(s | sets[k]):
                up[root(i)] = root(k)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((x for x in groups[root(i)] if x is not None), default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in N.near_duplicates(df, **kw).collect()), key=str)


def rows_of(seed, groups, extra=()):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(500))
    rows, i = list(extra), 0
    shared = [word() for _ in range(30)]
    for n, length, edits in groups:
        base = [word() for _ in range(length)]
        for _ in range(n):
            w = list(base)
            for _ in range(r.randrange(edits + 1)):
                w[r.randrange(len(w))] = word()
            rows.append((100 + i, " ".join(w if r.random() < 0.7 else shared + w).upper() if r.random() < 0.1 else " ".join(w)))
            i += 1
    r.shuffle(rows)
    return rows


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "ONE two"), (6, "one"), (None, "one two"), (7, "x y z u v w"), (7, "x y z u v w"), (8, "q " * 500), (9, "q " * 5000)]


def test_small(spark):
    rows = rows_of(1, [(1, 60, 0)] * 60 + [(5, 80, 3)] * 12 + [(30, 120, 8)], ODD)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


@pytest.mark.parametrize("part", [40, 2048])
def test_dense(spark, part):
    rows = rows_of(2, [(250, 100, 9), (1, 50, 0), (40, 60, 4)])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, node=8, part=part, depth=3) == brute(rows)


def swapped(n):
    """Two words of n bytes that agree in every sum of powers: the parity sequence of a and b, and its swap."""
    w = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_words_built_to_collide(spark):
    rows = []
    for i, n in enumerate((1024, 2048, 4096)):
        a, b = swapped(n)
        rows += [(10 * i + 1, f"x y {a} z"), (10 * i + 2, f"x y {b} z"), (10 * i + 3, f"x y {a} z")]
    # runs of two words in that order
    for i, n in enumerate((1024, 2048)):
        a, b = swapped(n)
        rows += [(100 + i, " ".join(a)), (200 + i, " ".join(b)), (300 + i, " ".join("p" + x for x in a[:40])), (400 + i, " ".join("p" + x for x in b[:40]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_drop_duplicates(spark):
    """One row of each class, all columns whole; rows without words stay."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, "a"), (None, text + " end", "b"), (5, text, "c"), (5, text, "c"), (7, None, "d"), (8, "", "e"), (7, None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ka string").withColumn("c", F.lit(1)).withColumn("_again", F.lit(2))
    out = N.drop_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.ka, r.c, r._again) for r in out.collect()) == [(5, "c", 1, 2), (7, "d", 1, 2), (7, "d", 1, 2), (8, "e", 1, 2)]
    nulls = spark.createDataFrame([(None, text), (None, text + " end"), (None, "other words only here now")], "doc_id long, text string")
    assert N.drop_duplicates(nulls).count() == 2


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in N.op6_near_dedup(spark, sf).collect()), key=str) == brute(rows)
