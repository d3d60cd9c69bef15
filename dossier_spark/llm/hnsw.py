"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one for each shard.

Vectors are dealt to shards by the hash of their id. In a shard equal vectors share one node. A node's top
layer falls geometrically; every layer is a graph kept as a flat array of neighbour numbers, filled with -1.
Nodes enter in batches: each batch searches the graph as it stands, adds its own members as candidates, takes
diverse near neighbours and gives back links. A search walks the upper layers from few entries, then keeps a
beam of `ef` nodes on the lowest one; all queries of a block step together in numpy. Shards answer with their
nearest in exact double precision; results merge by distance, then id.

Queries come in blocks, and every block meets every shard once. Every valid row is indexed and none is sampled.

Defined results: null ids and vectors that are null, empty, zero, or hold null or non-finite components take no
part. Vectors of different length never meet. Rows that repeat an id count once, with the least vector. With
fewer than k candidates all are returned. Only the id and the vector are read: other columns, whatever their names, are
left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SHARD, BLOCK_BYTES, STEP = 8192, 8 << 20, 256
LINKS, LINKS_LOW, EF_BUILD, EF = 16, 32, 64, 128


def beam(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entries: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Nodes near each query, (queries, ef) with their squared distances, nearest first; -1 and inf where fewer are reached."""
    n, b = len(x), len(q)
    norms, seen = (x * x).sum(1), np.zeros((b, n + 1), bool)
    ids = np.full((b, ef), -1, np.int64)
    dist = np.full((b, ef), np.inf, np.float32)
    done = np.ones((b, ef), bool)

    def offer(rows: np.ndarray, new: np.ndarray) -> None:
        new = np.where(new < 0, n, new)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new[seen[rows[:, None], new]] = n
        seen[rows[:, None], new] = True
        seen[:, n] = False
        at = np.minimum(new, n - 1)
        d = norms[at] - 2 * np.einsum("bmd,bd->bm", x[at], q[rows]) + (q[rows] ** 2).sum(1)[:, None]
        d = np.where(new == n, np.inf, np.maximum(d, 0)).astype(np.float32)
        all_d, all_i = np.concatenate([dist[rows], d], 1), np.concatenate([ids[rows], np.where(new == n, -1, new)], 1)
        all_done = np.concatenate([done[rows], new == n], 1)
        keep = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
        dist[rows], ids[rows], done[rows] = (np.take_along_axis(a, keep, 1) for a in (all_d, all_i, all_done))

    offer(np.arange(b), entries)
    while True:
        open_d = np.where(done, np.inf, dist)
        rows = np.flatnonzero(np.isfinite(open_d).any(1))
        if not len(rows):
            break
        pick = np.argpartition(open_d[rows], min(wide, ef - 1), axis=1)[:, :wide]
        chosen = np.where(np.isfinite(np.take_along_axis(open_d[rows], pick, 1)), np.take_along_axis(ids[rows], pick, 1), -1)
        mark = done[rows]
        np.put_along_axis(mark, pick, True, axis=1)
        done[rows] = mark
        near = np.where(chosen[:, :, None] < 0, -1, graph[np.maximum(chosen, 0)])
        offer(rows, near.reshape(len(rows), -1))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def diverse(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
    """Of candidates (b, ef) nearest first, m for each row: those nearer to the row than to any chosen before, then the nearest others."""
    b, e = ids.shape
    v = x[np.maximum(ids, 0)]
    sq = (v * v).sum(2)
    pair = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.swapaxes(1, 2))
    chosen = np.zeros((b, e), bool)
    for j in range(e):
        closest = np.where(chosen, pair[:, j, :], np.inf).min(1)
        chosen[:, j] = (ids[:, j] >= 0) & (dist[:, j] < closest) & (chosen.sum(1) < m)
    rank = np.where(ids < 0, 2 * e, np.where(chosen, 0, e) + np.arange(e)[None, :])
    best = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(ids, best, 1)
    if out.shape[1] < m:
        out = np.concatenate([out, np.full((b, m - out.shape[1]), -1, np.int64)], 1)
    return out


def layer(x: np.ndarray, m: int, capacity: int, ef: int, entries: Callable) -> np.ndarray:
    """The graph of one layer over the rows of x, entered in order. entries(rows, first) gives each new row places to start from among the first rows."""
    n = len(x)
    graph = np.full((n, capacity), -1, np.int64)
    first = 0
    while first < n:
        last = min(n, first + max(16, min(STEP, first)))
        rows = np.arange(first, last)
        own = np.broadcast_to(rows, (len(rows), len(rows)))
        d = (x[rows] ** 2).sum(1)[:, None] + (x[rows] ** 2).sum(1)[None, :] - 2 * x[rows] @ x[rows].T
        d = np.where(own == rows[:, None], np.inf, np.maximum(d, 0))
        ids, dist = np.where(np.isfinite(d), own, -1), d
        if first:
            f_ids, f_dist = beam(x[:first], graph[:first], x[rows], entries(rows, first), ef)
            ids, dist = np.concatenate([ids, f_ids], 1), np.concatenate([dist, f_dist], 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :ef]
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        near = diverse(x, ids, dist, m)
        graph[rows, :m] = near
        src, dst = np.repeat(rows, m), near.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        cut = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]][: len(dst)])
        full: list[tuple[int, np.ndarray]] = []
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(dst)] if len(cut) else [], strict=True):
            t = dst[lo]
            links = np.union1d(graph[t][graph[t] >= 0], src[lo:hi])
            if len(links) > capacity:
                full.append((t, links))
            else:
                graph[t, : len(links)] = links
        if full:
            ids = np.full((len(full), max(len(links) for _, links in full)), -1, np.int64)
            for i, (_, links) in enumerate(full):
                ids[i, : len(links)] = links
            at = np.array([t for t, _ in full])
            dist = np.where(ids < 0, np.inf, ((x[np.maximum(ids, 0)] - x[at][:, None]) ** 2).sum(2))
            order = np.argsort(dist, axis=1, kind="stable")[:, : 2 * capacity]
            graph[at] = diverse(x, np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), capacity)
        first = last
    return graph


class Index:
    """Layers over distinct vectors; layer l holds the first sizes[l] of them, since higher nodes come first."""

    def __init__(self, x: np.ndarray, sizes: list[int], graphs: list[np.ndarray]):
        self.x, self.sizes, self.graphs = x, sizes, graphs

    @classmethod
    def build(cls, x: np.ndarray, m: int = LINKS, low: int = LINKS_LOW, ef: int = EF_BUILD) -> tuple[Index, np.ndarray]:
        """The index and the order in which it took the rows of x."""
        n = len(x)
        u = (C.seeded(n, 21) >> np.uint64(11)).astype(np.float64) / 2.0**53
        level = np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(m)).astype(int)
        order = np.lexsort((u, -level))
        x = np.ascontiguousarray(x[order])
        sizes = [int((level >= t).sum()) for t in range(int(level.max(initial=0)) + 1)]
        index = cls(x, sizes, [np.zeros((0, 0), np.int64)] * len(sizes))
        for t in range(len(sizes) - 1, -1, -1):

            def entries(rows, first, t=t):
                starts = np.zeros((len(rows), 1), np.int64)
                for up in range(len(sizes) - 1, t, -1):
                    size = min(sizes[up], first)
                    graph = index.graphs[up][:size]
                    starts = beam(x[:size], np.where(graph < size, graph, -1), x[rows], starts, 4)[0]
                return starts

            index.graphs[t] = layer(x[: sizes[t]], m, low if t == 0 else m, ef, entries)
        return index, order

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        starts = np.zeros((len(q), 1), np.int64)
        for t in range(len(self.sizes) - 1, 0, -1):
            starts = beam(self.x[: self.sizes[t]], self.graphs[t], q, starts, 8)[0]
        return beam(self.x, self.graphs[0], q, starts, ef)[0]


def _stack(col, dim: int) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


def _least(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows in order of id, one for each id: that with the least vector."""
    order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    return order[np.r_[True, ids[order][1:] != ids[order][:-1]]] if len(ids) else order


def _build(key, rows):
    dim = key[0].as_py()
    ids, x = rows["vec_id"].to_numpy(), _stack(rows["v"], dim)
    keep = _least(ids, x)
    ids, x = ids[keep], x[keep]
    distinct, at = np.unique(x, axis=0, return_inverse=True)
    scale = float(np.abs(distinct).max()) or 1.0
    index, order = Index.build((distinct / scale).astype(np.float32))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    node = place[at.ravel()]
    by = np.argsort(node, kind="stable")  # members of each node together, ids rising
    starts = np.searchsorted(node[by], np.arange(len(order) + 1))
    graphs = b"".join(g.astype("<i4").tobytes() for g in index.graphs)
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "ids": [ids[by].tobytes()], "starts": [starts.astype(np.int64).tobytes()], "x": [distinct[order].tobytes()], "sizes": [np.array(index.sizes, np.int64).tobytes()], "graphs": [graphs]})


INDEX = "dim int, shard int, ids binary, starts binary, x binary, sizes binary, graphs binary"


def _open(row: dict) -> tuple[Index, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(row["x"], np.float64).reshape(-1, row["dim"])
    sizes, graphs, at = np.frombuffer(row["sizes"], np.int64).tolist(), [], 0
    for t, n in enumerate(sizes):
        width = LINKS_LOW if t == 0 else LINKS
        graphs.append(np.frombuffer(row["graphs"], "<i4", n * width, at).reshape(n, width).astype(np.int64))
        at += 4 * n * width
    scale = float(np.abs(x).max()) or 1.0
    return Index((x / scale).astype(np.float32), sizes, graphs), x, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int64)


def _search(k: int, ef: int) -> Callable:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                index, x, ids, starts = _open(row)
                scale = float(np.abs(x).max()) or 1.0
                qid, q = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["q"], np.float64).reshape(-1, row["dim"])
                out = {"query_id": [], "vec_id": [], "score": []}
                for lo in range(0, len(q), STEP):
                    block = q[lo : lo + STEP]
                    found = index.search(np.clip(block / scale, -1e15, 1e15).astype(np.float32), max(ef, k + 1))
                    for i, near in enumerate(found):
                        near = near[near >= 0]
                        d = distances(x[near], block[i])
                        o = np.argsort(d, kind="stable")
                        got_i, got_d = [], []
                        # of each node at most its k + 1 smallest ids can be among the nearest
                        for j in o:
                            members = ids[starts[near[j]] : starts[near[j] + 1]][: k + 1]
                            got_i.append(members)
                            got_d.append(np.full(len(members), d[j]))
                            if sum(map(len, got_i)) > k and j != o[-1] and d[j] < d[o[-1]] and len(got_i) > k:
                                break
                        gi, gd = np.concatenate(got_i), np.concatenate(got_d)
                        keep = gi != qid[lo + i]
                        gi, gd = gi[keep], gd[keep]
                        o = np.lexsort((gi, gd))[:k]
                        out["query_id"].append(np.full(len(o), qid[lo + i])), out["vec_id"].append(gi[o]), out["score"].append(gd[o])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[c]) if out[c] else [], t) for c, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))], list(out))

    return run


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares leave the range of doubles, from coordinates scaled by the greatest of them."""
    with np.errstate(over="ignore", under="ignore"):
        diff = x - q
        d = np.sqrt((diff**2).sum(1))
        most = np.abs(diff).max(1, initial=0)
        odd = np.flatnonzero(((d < 1e-140) | ~np.isfinite(d)) & (most > 0) & np.isfinite(most))
        d[odd] = most[odd] * np.sqrt(((diff[odd] / most[odd, None]) ** 2).sum(1))
    return d


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, v) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine).select("vec_id", F.size("v").alias("dim"), "v")


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """One row for each shard, written to the shared folder."""
    rows = valid(df, id_col, vector_col)
    # one row for each vector length
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("shards"))
    dealt = rows.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    # a task for each shard: a shard is little data but much work, so small partitions must not be put together
    tasks = max(1, sizes.agg(F.sum("shards")).first()[0] or 1)
    return C.written(dealt.select("dim", "shard", "vec_id", "v").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(_build, INDEX), "index")


def nearest(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, ef: int = EF, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, its own id left out. A shard is opened once for each
    block of queries of about block_bytes."""

    def pack(key, rows):
        dim = key[0].as_py()
        ids, x = rows["vec_id"].to_numpy(), _stack(rows["v"], dim)
        keep = _least(ids, x)
        return pa.table({"dim": pa.array([dim], pa.int32()), "qids": [ids[keep].tobytes()], "q": [x[keep].tobytes()]})

    q = valid(queries, id_col, vector_col)
    sizes = q.groupBy("dim").agg(F.ceil(F.count("*") * F.col("dim") * 8 / F.lit(block_bytes)).cast("int").alias("blocks"))
    blocks = q.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    blocks = blocks.select("dim", "block", "vec_id", "v").groupBy("dim", "block").applyInArrow(pack, "dim int, qids binary, q binary")
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("all"))
    pairs = blocks.join(shards, "dim").select("dim", "qids", "q", F.explode("all").alias("shard"))
    found = index.join(pairs, ["dim", "shard"]).mapInArrow(_search(k, ef), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(build_index(vectors), vectors.filter("vec_id % 100 = 0"))
