import random
import re
from collections import Counter, defaultdict

from dossier_spark.llm import collocations as K


def brute(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = defaultdict(list)
    often = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    for (lang, p), a in often.items():
        if any(len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), c in often.items() if x == lang):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min(cuts)  # noqa: E741
        found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in found.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in K.collocations(df, **options).collect())


def made(seed, n):
    r = random.Random(seed)
    words = ["a", "b", "É", "é", "New", "york", "\x00", "x y", "the", "日本"]
    gap = lambda: r.choice([" ", "  ", "\t", ", ", ".", "\n", " ", " "])
    return "".join(r.choice(words) + gap() for _ in range(n))


def test_brute_force(spark):
    rows = [(made(i, 60), ("en", "fr", None, "und")[i % 4]) for i in range(40)]
    rows += [(None, "en"), ("", None), (" .,; ", "fr"), ("one two three four five six seven", "en"), rows[0], rows[0]]
    assert run(spark, rows, least=4) == brute(rows, 4)
    assert run(spark, rows, least=2, top=7) == brute(rows, 2, top=7)
    assert run(spark, rows, least=3, longest=3) == brute(rows, 3, longest=3)


def test_subsumed_hot_and_ties(spark):
    rows = [("red green blue", "en")] * 30 + [("green blue", "en")] * 2 + [("p q. s t", "en")] * 10 + [("x " * 3000, "de"), ("y " * 2, "de")]
    got = run(spark, rows, least=10)
    assert got == brute(rows, 10)
    phrases = [g[2] for g in got]
    assert "red green" not in phrases and "green blue" in phrases and phrases.index("p q") < phrases.index("s t")


def test_long_counts_stay_exact(spark):
    """1000 * a * n is over 64 bits for counts of a large corpus."""
    one = lambda prefix, nxt, n, total: (("en", prefix, nxt, n, total, max(n)))
    big = 3_000_000_000_000
    rounds = [[one("", ["p", "q"], [big, big + 1], 10**13)], [one("p", ["q"], [big - 1], big - 1)]]
    a, l, r, n, score = K.scored([spark.createDataFrame(x, K.MERGED) for x in rounds], 100, 10).select("a", "l", "r", "n", "score").first()  # noqa: E741
    assert score == 1000 * a * n // (l * r) and (a, l, r, n) == (big - 1, big, big + 1, 10**13)


def test_filter_only_passes_too_much(spark):
    phrases = spark.createDataFrame([("en", f"w{i} v{i}") for i in range(500)], "lang string, phrase string")
    bits = K.may_be(phrases, 2)
    b = "|".join(f"w{i} v{i}" for i in range(1000)).replace("|", ".").encode()
    import numpy as np

    buf = np.frombuffer(b, np.uint8)
    s, e, doc, _ = K.words_of(buf, np.array([0, len(buf)]))
    h = K.phrase_hashes(buf, s, e, K.language_hashes(["en"])[doc], 2, 1)[1][::2]
    assert K.passes(bits, h[:500]).all() and K.passes(bits, h[500:]).sum() < 5


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert K.collocations(df).count() == 0
    df = spark.createDataFrame([("a b " * 200, "en", 1, "n")], "text string, lang string, rank int, phrase string")
    assert K.collocations(df).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and K.collocations(df).count() == 4
