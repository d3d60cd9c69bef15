import numpy as np
import pytest

from dossier_spark.llm import hnsw as H


def exact(ids, x, queries, k=10):
    out = {}
    for q in queries:
        i = ids.index(q)
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = sorted((float(d[j]), ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
        out[q] = order
    return out


def recall(got, want):
    hit = total = 0
    for q, order in want.items():
        limit = order[-1][0] if order else 0
        mine = got.get(q, [])
        hit += sum(1 for d, _ in mine if d <= limit * (1 + 1e-12))
        total += len(order)
    return hit / total


def collect(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert all(v == sorted(v) for v in got.values())
    return got


def test_recall_and_merge(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 24))
    x = (centres[r.integers(0, 30, 6000)] + 0.3 * r.normal(size=(6000, 24))).astype(np.float32).astype(float)
    x[100:1500] = x[7]  # a vector that many rows share
    ids = list(range(6000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = collect(H.nearest(H.build_index(df, shard=1500), df.filter("vec_id % 50 = 0"), block_bytes=50 * 24 * 8))
    want = exact(ids, x, [i for i in ids if i % 50 == 0])
    assert recall(got, want) > 0.95
    assert [i for _, i in got[200]] == [i for _, i in want[200]] == [7, *range(100, 109)]


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_a_full_shard(clustered):
    """One shard of the default size."""
    r = np.random.default_rng(9)
    n = H.SHARD
    x = r.normal(size=(n, 64))
    if clustered:
        x = r.normal(size=(40, 64))[r.integers(0, 40, n)] + 0.2 * x
    index, order = H.Index.build(x.astype(np.float32))
    q = x[::64]
    found = order[index.search(q.astype(np.float32), H.EF)]
    want = np.argsort(((x**2).sum(1)[None] - 2 * q @ x.T), axis=1)[:, :11]
    assert np.mean([len(set(a[:11]) & set(b)) / 11 for a, b in zip(found, want)]) > 0.95


def test_odd(spark):
    rows = [(0, [1.0, 0.0]), (100, [2.0, 0.0]), (3, [1.0, 0.5]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (3, [9.0, 9.0]), (200, [1.0, 2.0, 3.0]), (201, [1.0, 2.0, 4.0]), (300, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collect(H.nearest(H.build_index(df), df.filter("vec_id % 100 = 0")))
    assert got == {0: [(0.5, 3), (1.0, 100)], 100: [(1.0, 0), (float(np.sqrt(1.25)), 3)], 200: [(1.0, 201)]}
    none = df.filter("vec_id = 4")
    assert H.nearest(H.build_index(none), none).count() == 0


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    got = collect(H.op4_hnsw(spark, sf))
    want = exact(ids, x, [i for i in ids if i % 100 == 0])
    assert set(got) == set(want) and recall(got, want) > 0.95


def test_far_and_near_beyond_squares(spark):
    """Distances whose squares leave the range of doubles, and columns named like the operator's own."""
    big = spark.createDataFrame([(0, [1e200, 0.0], 1, 2), (1, [1e-200, 0.0], 1, 2), (2, [0.0, 3e-200], 1, 2), (3, [4e-200, 3e-200], 1, 2)], "vec_id long, embedding array<double>, rank int, dim int")
    got = {(r.query_id, r.vec_id): r.score for r in H.nearest(H.build_index(big), big).collect()}
    assert got[0, 1] == 1e200 and abs(got[1, 2] / 1e-200 - 10**0.5) < 1e-12 and abs(got[2, 3] / 4e-200 - 1) < 1e-12
    assert H.nearest(H.build_index(big), big).columns == ["query_id", "rank", "vec_id", "score"]
