"""Repeated-passage removal by difference-cover anchors.

A passage of WINDOW words that occurs at two places contains, at the same distance from both starts,
an anchor: a shorter run of words that begins at a position whose remainder modulo PERIOD is in a
difference cover. So only runs at cover positions are hashed and matched over the corpus (5 of 21
positions here). Matched anchors then extend: every window of WINDOW words that holds one is hashed
whole under another seed and matched again; words under a matched window are removed.

Two windows are equal if they agree in 80 bits of two independent hashes and in the part their hash falls to, of which
there are more the more text there is (an anchor, which only proposes, travels with 40); a row is known by 64 bits of
its content and, from another hash, the part that holds it.

Hot passages: each task first matches within itself, settles local repeats there, and sends one row
for each hash. A hash therefore reaches a reducer at most once per task, however common it is. Rows that repeat
whole (equal id and text) take part once; their own result needs no match, as each of their windows repeats.

Defined results: null or empty text has no words and nothing removed; the kept text of a null is ''.
Repeated rows (equal id and text) are copies of each other; null ids are allowed. Input columns other
than the text are returned unchanged, but those named like an output column are replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 6, 8, 18)
CHUNK = 1 << 20
BROADCAST_KEYS = 1 << 19  # keys of two longs
HITS = "part int, h binary, k binary, q binary, p binary"
CONFIRMED = "part int, k binary, p binary"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


ANCHOR_BYTES, WINDOW_BYTES = 5, 10


def packed(h: np.ndarray, g: np.ndarray) -> bytes:
    """Hashes as they travel: the upper bytes of h for anchors, h and more for windows."""
    if len(g):
        return np.concatenate([h.view(np.uint8).reshape(-1, 8), g.astype("<u2").view(np.uint8).reshape(-1, 2)], 1).tobytes()
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 8 - ANCHOR_BYTES :]).tobytes()


def unpacked(raw: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, WINDOW_BYTES if wide else ANCHOR_BYTES)
    h = np.zeros((len(rows), 8), np.uint8)
    if not wide:
        h[:, 8 - ANCHOR_BYTES :] = rows
        return h.view("<u8").ravel(), np.zeros(0, np.uint16)
    h[:] = rows[:, :8]
    return h.view("<u8").ravel(), np.ascontiguousarray(rows[:, 8:]).view("<u2").ravel()


def in_order(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (h, g) together, and where each such group begins. g may be empty."""
    order = np.argsort(h, kind="stable")
    if not len(g):
        return order, np.r_[True, h[order][1:] != h[order][:-1]][: len(h)]
    a, b = h[order], g[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((g, h))
        a, b = h[order], g[order]
    return order, np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(h)]


class Spool:
    """Collects (hash, more of it, row key, home part, position) and sends them out by hash part, local repeats settled."""

    def __init__(self, parts: int):
        self.parts, self.rows, self.n = parts, [], 0

    def add(self, h, g, k, q, p):
        self.rows.append((h, g, k, q, p))
        self.n += len(h)

    def flush(self) -> pa.RecordBatch | None:
        if not self.n:
            return None
        h, g, k, q, p = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        self.rows, self.n = [], 0
        order, first = in_order(h, g)
        h, g, k, q, p = h[order], g[order] if len(g) else g, k[order], q[order], p[order]
        size = np.diff(np.r_[np.flatnonzero(first), len(h)])
        local = np.repeat(size > 1, size)
        out = {"part": [], "h": [], "k": [], "q": [], "p": []}

        def put(part, rows, hashes):
            for name, value in (("part", part), ("h", hashes), ("k", k[rows].tobytes()), ("q", q[rows].tobytes()), ("p", p[rows].tobytes())):
                out[name].append(value)

        # one row for each hash travels; position -1 says that its own places are settled already
        to = (h % np.uint64(self.parts)).astype(np.int64)
        settled, p = p, np.where(local, -1, p).astype(np.int32)
        rows = np.flatnonzero(first)
        rows = rows[np.argsort(to[rows], kind="stable")]
        edges = np.flatnonzero(np.r_[True, np.diff(to[rows]) != 0])
        for lo, hi in zip(edges, np.r_[edges[1:], len(rows)], strict=True):
            put(int(to[rows[lo]]), rows[lo:hi], packed(h[rows[lo:hi]], g[rows[lo:hi]] if len(g) else g))
        p = settled
        rows = np.flatnonzero(local)
        for i, lo in enumerate(range(0, len(rows), 1 << 16)):
            put(int((h[0] + np.uint64(i)) % np.uint64(self.parts)), rows[lo : lo + (1 << 16)], b"")
        return pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), *(pa.array(out[x], pa.binary()) for x in "hkqp")], ["part", "h", "k", "q", "p"])


def _confirm(wide: bool) -> Callable:
    """Of one hash part, the places whose hash came from two or more places, packed by home part."""
    return lambda part: confirm(part, wide)


def confirm(part: pa.Table, wide: bool) -> pa.Table:
    cols = {x: part[x].to_pylist() for x in "hkqp"}
    h, g, k, q, p, done = [], [], [], [], [], []
    for hb, kb, qb, pb in zip(*(cols[x] for x in "hkqp"), strict=True):
        row = (np.frombuffer(kb, np.int64), np.frombuffer(qb, np.int32), np.frombuffer(pb, np.int32))
        if hb:
            x, y = unpacked(hb, wide)
            h.append(x), g.append(y)
            k.append(row[0]), q.append(row[1]), p.append(row[2])
        else:
            done.append(row)
    if h:
        h, g, k, q, p = (np.concatenate(x) for x in (h, g, k, q, p))
        order, first = in_order(h, g)
        size = np.diff(np.r_[np.flatnonzero(first), len(h)])
        rows = order[np.repeat(size > 1, size)]
        rows = rows[p[rows] >= 0]
        done.append((k[rows], q[rows], p[rows]))
    if not done:
        return pa.table({"part": pa.array([], pa.int32()), "k": pa.array([], pa.binary()), "p": pa.array([], pa.binary())})
    k, q, p = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(q, kind="stable")
    k, q, p = k[order], q[order], p[order]
    edges = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    ends = np.r_[edges[1:], len(q)]
    spans = list(zip(edges, ends, strict=True)) if len(q) else []
    return pa.table({"part": pa.array([int(q[a]) for a, _ in spans], pa.int32()), "k": C.binaries(k[a:b] for a, b in spans), "p": C.binaries(p[a:b] for a, b in spans)})


def _anchor_map(parts: int, window: int, period: int, cover: tuple[int, ...]) -> Callable:
    length = window - period + 1
    in_cover = np.isin(np.arange(period), cover)

    def run(batches):
        spool = Spool(parts)
        for batch in batches:
            buf, offs = C.text_buffers(batch["text"])
            keys, home = np.asarray(batch["k"]), np.asarray(batch["part"])
            for lo, hi in C.doc_slices(offs):
                b, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                s, e, n = C.word_spans(b, o)
                if not len(s):
                    continue
                pos, doc = C.within(n), np.repeat(np.arange(lo, hi), n)
                at = np.flatnonzero(in_cover[pos % period] & (pos + length <= np.repeat(n, n)) & (np.repeat(n, n) >= window))
                if len(at):
                    h = C.run_hashes(C.word_hashes(b, s, e, 1), at, length)
                    spool.add(h, np.zeros(0, np.uint16), keys[doc[at]], home[doc[at]].astype(np.int32), pos[at].astype(np.int32))
                if spool.n >= CHUNK and (out := spool.flush()):
                    yield out
        if out := spool.flush():
            yield out

    return run


def places_of(keys: np.ndarray, found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Found positions as (index into keys, position), for every row that carries the key."""
    if not found.num_rows or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.concatenate([np.frombuffer(x, np.int64) for x in found["k"].to_pylist()])
    p = np.concatenate([np.frombuffer(x, np.int32) for x in found["p"].to_pylist()]).astype(np.int64)
    both = np.unique(np.stack([k, p], 1), axis=0) if len(k) < 4096 else _unique_pairs(k, p)
    k, p = both[:, 0], both[:, 1]
    lo, hi = np.searchsorted(k, keys, "left"), np.searchsorted(k, keys, "right")
    counts = hi - lo
    rows = np.repeat(np.arange(len(keys)), counts)
    return rows, p[np.repeat(lo, counts) + C.within(counts)]


def _unique_pairs(k: np.ndarray, p: np.ndarray) -> np.ndarray:
    order = np.lexsort((p, k))
    k, p = k[order], p[order]
    keep = np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])]
    return np.stack([k[keep], p[keep]], 1)


def _docs_with(docs: pa.Table, found: pa.Table):
    """Slices of the texts with what was found in them: (first, last, bytes, offsets, word spans, counts, word index of each hit)."""
    buf, offs = C.text_buffers(docs["text"])
    rows, pos = places_of(docs["k"].to_numpy(), found)
    cuts = np.searchsorted(rows, np.arange(len(offs)))
    for lo, hi in C.doc_slices(offs):
        b, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        s, e, n = C.word_spans(b, o)
        base = np.cumsum(n) - n
        r, p = rows[cuts[lo] : cuts[hi]] - lo, pos[cuts[lo] : cuts[hi]]
        yield lo, hi, b, s, e, n, base, r, base[r] + p if len(r) else r


def _window_map(parts: int, window: int, period: int) -> Callable:
    def run(key, docs: pa.Table, found: pa.Table) -> pa.Table:
        spool, out = Spool(parts), []
        keys = docs["k"].to_numpy() if docs.num_rows else np.zeros(0, np.int64)
        for lo, _, b, s, e, n, base, r, at in _docs_with(docs, found) if found.num_rows else ():
            if not len(r):
                continue
            # starts that an anchor reaches: from period - 1 words before it up to itself, whole windows only
            mark = np.zeros(len(s) + 1, np.int32)
            np.add.at(mark, np.maximum(at - (period - 1), base[r]), 1)
            np.add.at(mark, at + 1, -1)
            room = np.repeat(base + n - window, n)
            starts = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (np.arange(len(s)) <= room))
            if not len(starts):
                continue
            doc = np.repeat(np.arange(len(n)), n)[starts]
            h = C.run_hashes(C.word_hashes(b, s, e, 2), starts, window)
            g = (C.run_hashes(C.word_hashes(b, s, e, 5), starts, window) >> np.uint64(48)).astype(np.uint16)
            spool.add(h, g, keys[lo + doc], np.full(len(h), key[0].as_py(), np.int32), (starts - base[doc]).astype(np.int32))
            if spool.n >= CHUNK:
                out.append(spool.flush())
        if (last := spool.flush()) is not None:
            out.append(last)
        return pa.Table.from_batches(out, _schema(HITS))

    return run


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _cut(window: int) -> Callable:
    def run(key, docs: pa.Table, found: pa.Table) -> pa.Table:
        n_words, n_removed, kept, digests = [], [], [], []
        whole = docs["text"].to_pylist()
        for lo, hi, b, s, e, n, base, r, at in _docs_with(docs, found):
            mark = np.zeros(len(s) + 1, np.int32)
            if len(r):
                np.add.at(mark, at, 1)
                np.add.at(mark, at + window, -1)
            keep = np.cumsum(mark[:-1]) == 0
            gone = np.zeros(len(s) + 1, np.int64)
            np.cumsum(~keep, out=gone[1:])
            n_words.append(n)
            n_removed.append(gone[base + n] - gone[base])
            # kept words, each followed by one space, copied in one gather
            ss, ln = s[keep], (e - s)[keep]
            idx = np.repeat(ss, ln + 1) + C.within(ln + 1)
            flat = b[np.minimum(idx, max(len(b) - 1, 0))] if len(idx) else np.zeros(0, np.uint8)
            if len(flat):
                flat[np.cumsum(ln + 1) - 1] = 0x20
            size = np.zeros(len(ss) + 1, np.int64)
            np.cumsum(ln + 1, out=size[1:])
            seen = np.zeros(len(s) + 1, np.int64)
            np.cumsum(keep, out=seen[1:])
            raw = flat.tobytes()
            for i, (a, z, cut) in enumerate(zip(size[seen[base]].tolist(), size[seen[base + n]].tolist(), n_removed[-1].tolist(), strict=True)):
                words = raw[a : max(a, z - 1)]
                digests.append(hashlib.sha256(words).hexdigest())
                kept.append(words.decode() if cut else whole[lo + i] or "")
        cols = {"rest": docs["rest"]}
        cols |= {"n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), "n_removed": pa.array(np.concatenate(n_removed) if n_removed else [], pa.int64())}
        cols |= {"kept_text": pa.array(kept, pa.string()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(cols)

    return run


def remove_repeated_passages(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Every row of df without its words under a window of `window` words that also starts anywhere else.

    Returns df's columns but the text, then n_words, n_removed, kept_text (the kept words joined by one space;
    the text as it was if all are kept) and kept_sha256 (of the kept words joined by one space).
    """
    assert is_cover(cover, period) and period < window
    spark = df.sparkSession
    parts = C.parts_for(spark, df, text_col)
    made = ("n_words", "n_removed", "kept_text", "kept_sha256")
    rest = [c for c in df.columns if c not in (text_col, *made)]
    ka, kb = C.row_keys(id_col, text_col)
    docs = df.select(ka, kb, F.col(text_col).cast("string").alias("text"), F.struct(*rest).alias("rest")).withColumn("part", F.pmod("kb", F.lit(parts)).cast("int"))
    again = C.written(docs.groupBy("ka", "kb").agg(F.count("*").alias("n")).filter("n > 1").select("ka", "kb"), "again")
    repeats = again.count()
    out = T.StructType([T.StructField("rest", docs.schema["rest"].dataType), *(T.StructField(x, T.LongType()) for x in made[:2]), *(T.StructField(x, T.StringType()) for x in made[2:])])
    if not repeats:
        return _matched(docs, parts, window, period, cover, out).select("rest.*", *made)
    again = F.broadcast(again) if repeats <= BROADCAST_KEYS else again
    repeated = docs.join(again, ["ka", "kb"], "left_semi")
    one = repeated.dropDuplicates(["ka", "kb"]).withColumn("rest", F.lit(None).cast(docs.schema["rest"].dataType))
    single = docs.join(again, ["ka", "kb"], "left_anti")
    cut = _matched(single.unionByName(one), parts, window, period, cover, out).filter("rest is not null")
    return cut.unionByName(repeated.select("text", "rest").mapInArrow(C.tidy(_all_or_nothing(window)), out)).select("rest.*", *made)


def _matched(docs: DataFrame, parts: int, window: int, period: int, cover: tuple[int, ...], out: T.StructType) -> DataFrame:
    """Rows (ka, kb, text, rest, part) without their repeated passages."""
    docs = docs.select(F.col("ka").alias("k"), "part", "text", "rest")
    thin = docs.select("k", "part", "text")
    matched = lambda hits, wide: hits.groupBy("part").applyInArrow(C.tidy_groups(_confirm(wide)), CONFIRMED)
    anchors = matched(thin.mapInArrow(C.tidy(_anchor_map(parts, window, period, cover)), HITS), False)
    by_part = docs.groupBy("part")
    windows = matched(by_part.cogroup(anchors.groupBy("part")).applyInArrow(C.tidy_groups(_window_map(parts, window, period)), HITS), True)
    return by_part.cogroup(windows.groupBy("part")).applyInArrow(C.tidy_groups(_cut(window)), out)


def _all_or_nothing(window: int) -> Callable:
    """Rows whose every window repeats: all words go, or none where a text is shorter than a window."""

    def run(batches):
        for batch in batches:
            texts = [t.as_py() or "" for t in batch["text"]]
            buf, offs = C.text_buffers(batch["text"])
            n = np.concatenate([C.word_spans(buf[offs[a] : offs[z]], offs[a : z + 1] - offs[a])[2] for a, z in C.doc_slices(offs)] or [np.zeros(0, np.int64)])
            gone = np.where(n >= window, n, 0)
            kept = ["" if g else t for t, g in zip(texts, gone, strict=True)]
            sha = [hashlib.sha256(b" ".join(WORD.findall(t.encode()))).hexdigest() for t in kept]
            yield pa.RecordBatch.from_arrays([batch["rest"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], ["rest", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
