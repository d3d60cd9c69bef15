import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from dossier_spark.llm import prefix_trie as P

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    """rows (conv_id, turn, role, text): the nodes, with a walk over the trie."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0), digest(role, text), role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: y[:2])] for c, x in turns.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + x[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(p)).encode()).hexdigest()
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], ends))
    return sorted(out, key=str)


def run(spark, rows, block_bytes=P.BLOCK_BYTES):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    return sorted((tuple(r[c] for c in NAMES) for r in P.prefix_trie(df, block_bytes).collect()), key=str)


def made(seed, convs, words=3):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c * r.choice([1, 3]), t, r.choice(["user", "bot"]), " ".join(["a", "b c"][r.randrange(2)] for _ in range(r.randrange(words)))))
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 23, 600])
def test_brute_force(spark, block_bytes):
    """Blocks of 600 bytes hold a few conversations each, so that most nodes reach over borders."""
    rows = made(1, 150) + [(-41, 1, "user", "x"), (-40, 1, "user", "x"), (-40, None, None, None), (7_000, 0, "u", "only"), (7_001, 0, "u", "one"), (None, 0, "u", "lost")]
    rows += [(1000 + i, 0, "user", "hello there") for i in range(60)] + [(1000 + i, 1, "bot", "hi") for i in range(50)]
    assert run(spark, rows, block_bytes) == brute(rows)


def test_hot_conversation_over_many_blocks(spark):
    rows = [(i, t, "user", f"same {t}") for i in range(0, 2000, 20) for t in range(6)] + [(i, 0, "user", "same 0") for i in range(5000, 5040)]
    assert run(spark, rows, 400) == brute(rows)


def test_long_empty_ties_repeats(spark):
    rows = [(1, t, "u", "w " * (t % 3)) for t in range(700)] + [(2, t, "u", "w " * (t % 3)) for t in range(650)]
    rows += [(40, 0, "u", "long " * 5000), (40, 0, "b", "tie"), (40, 0, "b", "tie"), (41, 5, None, ""), (41, 5, "", None)]
    assert run(spark, rows, 2000) == brute(rows)
    assert run(spark, [(3, 0, "u", "one")]) == brute([(3, 0, "u", "one")])  # loses its turn or keeps it: root and one node at most


def test_no_rows_and_clashing_names(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(0, 0, "u", "a b", 1, "k")], "conv_id long, turn int, role string, text string, depth int, key string")
    assert {r.depth for r in P.prefix_trie(df).collect()} == {0, 1}


def test_minima():
    r = random.Random(2)
    v = np.array([r.randrange(6) for _ in range(97)], np.int64)
    m = P.Minima(v)
    at = np.repeat(np.arange(97), 6)
    least = np.tile(np.arange(1, 7), 97)
    right, left = m.right(at, least), m.left(at, least)
    for a, d, z, x in zip(at, least, right, left):
        assert z == next((j for j in range(a + 1, 97) if v[j] < d), 97)
        assert x == next((j for j in range(a, 0, -1) if v[j] < d), 0)
    assert (m.least(at, right) == [v[a:z].min() for a, z in zip(at, right)]).all()
