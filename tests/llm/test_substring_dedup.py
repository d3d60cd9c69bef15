import hashlib
import random
import re
from collections import Counter

from dossier_spark.llm import substring_dedup as S


def brute(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = S.remove_repeated_passages(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted(map(tuple, got), key=str)


def swapped(n):
    w = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_cover():
    assert S.is_cover(S.COVER, S.PERIOD) and not S.is_cover((0, 1), 21)


def test_planted(spark):
    r = random.Random(1)
    text = lambda n: " ".join(r.choice("abcdefghé") + str(r.randrange(400)) for _ in range(n))
    rows = [(i, text(r.randrange(0, 120))) for i in range(60)]
    for n in (34, 35, 36, 50, 54, 55, 56, 90):
        p = text(n)
        for i in range(3):
            rows.append((1000 + 10 * n + i, text(r.randrange(40)) + "\n" + p + "\t" + text(r.randrange(40))))
    rows += [(5000, "x " * 100), (5001, "y " * 35), (5002, "y " * 34), (None, rows[3][1]), (7, None), (8, ""), (8, ""), (9, rows[9][1]), (9, rows[9][1]), (9, text(60))]
    rows += [(6000 + i, rows[70][1]) for i in range(20)]
    assert run(spark, rows) == brute(rows)


def test_words_built_to_collide(spark):
    """34 shared words after different long words that agree in every sum of powers; runs of two words in that order."""
    tail, rows = " ".join(f"t{i}" for i in range(34)), []
    for i, n in enumerate((1024, 2048, 4096)):
        a, b = swapped(n)
        rows += [(10 * i, f"{a} {tail} u{i}"), (10 * i + 1, f"{b} {tail} v{i}")]
    a, b = swapped(2048)
    rows += [(100, " ".join(a)), (101, " ".join(b)), (102, " ".join("p" + x for x in a[:40])), (103, " ".join("p" + x for x in b[:40]))]
    assert run(spark, rows) == brute(rows)


def test_many_equal_rows(spark):
    r = random.Random(3)
    long, short = " ".join(f"w{r.randrange(90)}" for _ in range(50)), " ".join(f"s{i}" for i in range(20))
    rows = [(1, long)] * 40 + [(2, short)] * 30 + [(None, long + " more")] * 5 + [(3, "x " + long[: len(long) // 2]), (4, None), (4, None)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeated_passages(df).count() == 0
    df = spark.createDataFrame([(1, "a\n b", 5, 7, None)], "doc_id long, text string, n_words int, k int, part string")
    got = S.remove_repeated_passages(df).collect()[0]
    assert (got.n_words, got.k, got.part, got.kept_text) == (2, 7, None, "a\n b")


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, S.op8_substring_dedup(spark, sf).collect()), key=str) == brute(rows)
