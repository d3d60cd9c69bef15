"""Removal of repeated byte strings by a logarithmic family of suffix arrays.

Any WINDOW bytes hold one chosen place among their first REACH: that of the least hash of 16 bytes, which the window's
content alone decides. Only suffixes at chosen places are indexed (a sparse suffix array, about one suffix in 69 bytes),
ordered by their first DEPTH bytes, all of which lie within the window. The corpus arrives in batches. A batch gets its
suffix array, dealt over parts by a hash of those bytes and sorted within each; it is merge-scanned against every
level of the family, where equal suffixes are matches; levels of equal size merge into one of twice the size. Levels
are tables bucketed by part, so no level is ever shuffled again.

A match of DEPTH bytes only proposes. For each matched place the text of the windows that it stands for goes to the part
of its suffix, where sorting the texts to the right and, reversed, to the left of the place gives for each offset the classes
of equal contexts; a window repeats if both its classes do in another place. That is exact, without hashes.
Places whose suffix is matched over HOT times would make one group of a common line; their windows are sent by
128-bit hashes instead, each to a part of its own.

Hot texts: a task settles what repeats within it and sends each suffix, segment and window once, however often it occurs.
Texts that repeat whole take part once; their own result needs no match.

Defined results: null and empty texts have no bytes and nothing removed; kept is what remains, in order (bytes, as a cut
may fall within a character). Repeated rows are copies of each other; null ids are allowed. Texts of any length are
read in pieces. Other columns are returned unchanged, but those named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier_spark.sources import files

from . import common as C

WINDOW, DEPTH = 200, 64
BATCHES, HOT, MOST_HOT = 4, 1 << 13, 1 << 19
PIECE, CHUNK, PART = 1 << 20, 1 << 19, 16 << 20
BROADCAST_KEYS = 1 << 19  # keys of two longs
INDEX = "part int, entries binary, places binary"
MADE = ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")


# ---------------------------------------------------------------- chosen places and their suffixes


def pieces(offs: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first byte, last byte, text offsets): whole texts of about PIECE bytes together, or a piece of a long one, in which
    every window of the text lies in exactly one piece."""
    for lo, hi in C.doc_slices(offs, PIECE):
        a, z = int(offs[lo]), int(offs[hi])
        if hi - lo > 1 or z - a <= 2 * PIECE:
            yield a, z, offs[lo : hi + 1]
            continue
        for at in range(a, max(z - window, a) + 1, PIECE):
            end = min(at + PIECE + window - 1, z)
            yield at, end, np.array([at, end])


def least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` keys in a row."""
    n = len(keys)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def chosen(b: np.ndarray, offs: np.ndarray, window: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts of the texts in b, and the chosen place of each."""
    reach = window - depth + 1
    size = np.diff(offs)
    free = np.maximum(size - window + 1, 0)
    starts = np.repeat(offs[:-1], free) + C.within(free)
    if not len(starts):
        return starts, starts
    room = np.concatenate([b, np.zeros(16, np.uint8)])
    at8 = np.ndarray((len(b) + 9,), "<u8", room, strides=(1,))
    h = C.mix(C.mix(at8[: len(b)] + C.ODD) + at8[8 : len(b) + 8] * C.ODD2)
    low = np.uint64((1 << len(b).bit_length()) - 1)
    keys = (h & ~low) | np.arange(len(b), dtype=np.uint64)
    return starts, (least_of(keys, reach)[starts] & low).astype(np.int64)


def runs_of(starts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chosen place: the place, and the first and last window start that it stands for."""
    if not len(starts):
        return starts, starts, starts
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    return place[new], starts[new], starts[np.r_[new[1:], len(starts)] - 1]


def suffix_words(b: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The first depth bytes of each suffix as numbers of eight bytes that sort like them."""
    at8 = np.ndarray((max(len(b) - 7, 0),), ">u8", np.ascontiguousarray(b), strides=(1,))
    return np.stack([at8[at + j] for j in range(0, depth, 8)], 1).astype(np.uint64)


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by all columns, and where each run of equal rows begins. Only tied rows are looked at further; rows that come
    as sorted runs are merged."""
    n = len(words)
    order = np.argsort(words[:, 0], kind="stable")
    first = words[order, 0]
    new = np.r_[True, first[1:] != first[:-1]][:n]
    for j in range(1, words.shape[1]):
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
        if not len(tied):
            break
        w = words[order[tied], j]
        by = np.lexsort((w, group[tied]))
        order[tied] = order[tied][by]
        w = w[by]
        new[tied] |= np.r_[True, w[1:] != w[:-1]]
    return order, new


def tag_of(words: np.ndarray) -> np.ndarray:
    """A hash of whole suffix heads: their part and the tag of their places."""
    out = np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        out = C.join(out, words[:, j])
    return out


# ---------------------------------------------------------------- index parts: (words, places) packed; a place is (home, row, position, tag)


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(arrays[0])], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(raw: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    """Columns back, each (n, width) of a kind."""
    data = zstandard.ZstdDecompressor().decompress(raw)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind, width in kinds:
        out.append(np.frombuffer(data, kind, n * width, at).reshape(n, width))
        at += n * width * np.dtype(kind).itemsize
    return out


def entries(raw: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    cols, places = unpack(raw, (np.uint64, depth // 8), (np.int32, 4))
    return cols, places


def settle(words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct suffixes with their one place, or -1 where the place is settled; and the places that were matched here."""
    if not len(words):
        return words, places, places
    order, new = suffix_order(words)
    edge = np.flatnonzero(new)
    size = np.diff(np.r_[edge, len(order)])
    matched = order[np.repeat(size > 1, size)]
    matched = places[matched]
    one = places[order[edge]].copy()
    one[size > 1, 1] = -1
    return words[order[edge]], one, matched[matched[:, 1] >= 0]


def _suffixes(parts: int, window: int, depth: int) -> Callable:
    """Rows of a batch to pieces of its suffix array, dealt by part; what repeats within a chunk is settled here."""

    def out(held):
        words, places, matched = settle(np.concatenate([w for w, _ in held]), np.concatenate([p for _, p in held]))
        part = (tag_of(words) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
        spans = list(zip(edge.tolist(), np.r_[edge[1:], len(order)].tolist(), strict=True))
        rows = [(int(part[order[a]]), pack(words[order[a:z]], places[order[a:z]]), None) for a, z in spans]
        for i, a in enumerate(range(0, len(matched), 1 << 15)):
            rows.append((int(part[i % len(part)]), None, pack(matched[a : a + (1 << 15)])))
        p, e, m = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.binary()), pa.array(m, pa.binary())], ["part", "entries", "places"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            buf, offs = C.text_buffers(batch["raw"])
            home, row = batch["home"].to_numpy(), batch["row"].to_numpy()
            for a, z, cut in pieces(offs, window):
                b = buf[a:z]
                at, _, _ = runs_of(*chosen(b, cut - a, window, depth))
                if len(at):
                    doc = np.searchsorted(offs, at + a, side="right") - 1
                    words = suffix_words(b, at, depth)
                    held.append((words, np.stack([home[doc], row[doc], at + a - offs[doc], tag_of(words).astype(np.uint32).view(np.int32)], 1).astype(np.int32)))
                    n += len(at)
                if n >= CHUNK:
                    yield out(held)
                    held, n = [], 0
        if n:
            yield out(held)

    return run


def _row(part: int, words: np.ndarray, places: np.ndarray, matched: np.ndarray, keep: bool) -> pa.Table:
    return pa.table({"part": pa.array([part], pa.int32()), "entries": pa.array([pack(words, places) if keep else None], pa.binary()), "places": pa.array([pack(matched)], pa.binary())})


def _gather(depth: int) -> Callable:
    """The pieces of one part of a batch's suffix array, merged."""

    def run(rows: pa.Table) -> pa.Table:
        held = [entries(x, depth) for x in rows["entries"].to_pylist() if x]
        done = [unpack(x, (np.int32, 4))[0] for x in rows["places"].to_pylist() if x]
        held.append((np.zeros((0, depth // 8), np.uint64), np.zeros((0, 4), np.int32)))
        words, places, matched = settle(np.concatenate([w for w, _ in held]), np.concatenate([p for _, p in held]))
        return _row(rows["part"][0].as_py(), words, places, np.concatenate([matched, *done]), True)

    return run


def _merge_scan(depth: int, keep: bool) -> Callable:
    """A part of a new suffix array against that of a level: matches, and if asked for the merged array."""

    def run(key, new: pa.Table, level: pa.Table) -> pa.Table:
        held = [entries(x, depth) for t in (level, new) for x in t["entries"].to_pylist()]
        words, places, matched = settle(np.concatenate([w for w, _ in held]), np.concatenate([p for _, p in held]))
        return _row(key[0].as_py(), words, places, matched, keep)

    return run


class Family:
    """Levels of suffix arrays, level i from 2^i batches; `places` are the tables with the places matched so far."""

    def __init__(self, spark: SparkSession, parts: int, window: int = WINDOW, depth: int = DEPTH):
        self.spark, self.parts, self.window, self.depth = spark, parts, window, depth
        self.levels: dict[int, DataFrame] = {}
        self.places: list[DataFrame] = []
        self.names: list[tuple[str, str]] = []

    def bucketed(self, df: DataFrame, column: str) -> DataFrame:
        """df as a table bucketed by the column, in the shared folder."""
        name, path = f"suffix_{uuid.uuid4().hex}", files.scratch(self.spark, "suffix")
        df.write.mode("append").bucketBy(self.parts, column).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        self.names.append((name, path))
        return self.spark.table(name)

    def scan(self, new: DataFrame, level: DataFrame, keep: bool) -> DataFrame:
        both = new.select("part", "entries").groupBy("part").cogroup(level.select("part", "entries").groupBy("part"))
        return both.applyInArrow(C.tidy_groups(_merge_scan(self.depth, keep)), INDEX)

    def add(self, batch: DataFrame, last: bool = False) -> None:
        """Index rows (home, row, raw) and match them with all before. After the last batch nothing is kept to merge with."""
        pieces = batch.select("home", "row", "raw").mapInArrow(C.tidy(_suffixes(self.parts, self.window, self.depth)), INDEX)
        new = self.bucketed(pieces.groupBy("part").applyInArrow(C.tidy_groups(_gather(self.depth)), INDEX), "part")
        self.places.append(new.select("places"))
        merged, height = new, 0
        for at in sorted(self.levels):
            if last or at != height:
                self.places.append(C.written(self.scan(new, self.levels[at], False).select("places"), "places", "none"))
                continue
            merged = self.bucketed(self.scan(merged, self.levels.pop(at), True), "part")
            self.places.append(merged.select("places"))
            height += 1
        if not last:
            self.levels[height] = merged

    def __enter__(self) -> Family:
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.drop()

    def drop(self) -> None:
        """Delete the levels and all other tables of the family."""
        for name, path in self.names:
            self.spark.sql(f"drop table if exists {name}")
            files.delete(self.spark, path)


# ---------------------------------------------------------------- from matched places to repeated windows


def _by_home(batches):
    for batch in batches:
        for raw in batch["places"]:
            p = unpack(raw.as_py(), (np.int32, 4))[0]
            p = p[np.argsort(p[:, 0], kind="stable")]
            edge = np.flatnonzero(np.r_[True, np.diff(p[:, 0]) != 0]) if len(p) else np.zeros(0, int)
            spans = list(zip(edge.tolist(), np.r_[edge[1:], len(p)].tolist(), strict=True)) if len(p) else []
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array([int(p[a, 0]) for a, _ in spans], pa.int32()), C.binaries([pack(p[a:z]) for a, z in spans])], ["home", "places"])


def _tags(batches):
    for batch in batches:
        for raw in batch["places"]:
            tag, n = np.unique(unpack(raw.as_py(), (np.int32, 4))[0][:, 3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tag, pa.int32()), pa.array(n, pa.int64())], ["tag", "n"])


def hot_tags(places: DataFrame, hot: int) -> np.ndarray:
    """Tags of the suffixes matched over `hot` times: MOST_HOT of them at most, or else `hot` is doubled until they are."""
    counts = C.written(places.mapInArrow(_tags, "tag int, n long").groupBy("tag").agg(F.sum("n").alias("n")).filter(F.col("n") > hot), "tags")
    while counts.filter(F.col("n") > hot).count() > MOST_HOT:
        hot *= 2
    return np.array(sorted(r["tag"] for r in counts.filter(F.col("n") > hot).select("tag").collect()), np.int32)


SENT = "part int, home int, kind int, data binary"
SEGMENT, WINDOWS, SPANS = 0, 1, 2


def window_hashes(b: np.ndarray, starts: np.ndarray, window: int, seed: int) -> np.ndarray:
    return C.run_hashes(C.mix(b.astype(np.uint64) + C.seeded(1, seed)[0]), starts, window)


def _segments(parts: int, window: int, depth: int, hot) -> Callable:
    """Of the texts of one home, what has to be compared elsewhere: segments around matched places, windows of hot ones."""

    def run(key, docs: pa.Table, found: pa.Table) -> pa.Table:
        home, rows = key[0].as_py(), []
        if not found.num_rows or not docs.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "home": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        places = np.concatenate([unpack(x, (np.int32, 4))[0] for x in found["places"].to_pylist()])
        ids = docs["row"].to_numpy()
        docs = docs.take(pa.array(np.argsort(ids)))
        ids = docs["row"].to_numpy()
        buf, offs = C.text_buffers(docs["raw"])
        flat = np.unique(offs[np.searchsorted(ids, places[:, 1])] + places[:, 2])  # bytes that are matched places
        seen: dict[tuple, list] = {}
        wide = []
        for a, z, cut in pieces(offs, window):
            if np.searchsorted(flat, a) == np.searchsorted(flat, z):
                continue
            b = buf[a:z]
            at, first, last = runs_of(*chosen(b, cut - a, window, depth))
            is_in = flat[np.minimum(np.searchsorted(flat, at + a), len(flat) - 1)] == at + a
            at, first, last = at[is_in], first[is_in], last[is_in]
            if not len(at):
                continue
            doc = np.searchsorted(offs, first + a, side="right") - 1
            tags = tag_of(suffix_words(b, at, depth))
            is_hot = np.isin(tags.astype(np.uint32).view(np.int32), hot.value)
            where = np.stack([ids[doc], first + a - offs[doc]], 1)
            text = b.tobytes()
            for m, f, e, (r, s), tag in zip(*(x[~is_hot].tolist() for x in (at, first, last, where, tags)), strict=True):
                seen.setdefault((text[f : e + window], m - f, tag), []).append((r, s))
            if is_hot.any():
                free = (last - first + 1)[is_hot]
                starts = np.repeat(first[is_hot], free) + C.within(free)
                owner = np.repeat(where[is_hot], free, axis=0)
                owner[:, 1] += C.within(free)
                wide.append((window_hashes(b, starts, window, 21), window_hashes(b, starts, window, 22), owner.astype(np.int32)))
        spans, by_part = [], {}
        for (text, offset, tag), where in seen.items():
            n = len(text) - window + 1
            if len(where) > 1:
                spans += [(r, s, s + n) for r, s in where]
            r, s = (-1, 0) if len(where) > 1 else where[0]
            by_part.setdefault(tag % parts, []).append((r, s, offset, text))
        for part, held in by_part.items():
            head = np.array([(r, s, o, len(t)) for r, s, o, t in held], np.int32)
            body = zstandard.ZstdCompressor(level=1).compress(np.array([len(held)], np.int64).tobytes() + head.tobytes() + b"".join(t for *_, t in held))
            rows.append((part, home, SEGMENT, body))
        if wide:
            h, g, owner = (np.concatenate(x) for x in zip(*wide, strict=True))
            order = np.lexsort((g, h))
            h, g, owner = h[order], g[order], owner[order]
            new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            size = np.diff(np.r_[new, len(h)])
            twice = owner[np.repeat(size > 1, size)]
            spans += [(r, s, s + 1) for r, s in twice.tolist()]
            one = owner[new].copy()
            one[size > 1, 0] = -1
            part = (h[new] % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(part[by]) != 0])
            for lo, hi in zip(edge.tolist(), np.r_[edge[1:], len(by)].tolist(), strict=True):
                rows.append((int(part[by[lo]]), home, WINDOWS, pack(h[new][by[lo:hi]], g[new][by[lo:hi]], one[by[lo:hi]])))
        if spans:
            rows.append((home % parts, home, SPANS, pack(joined_spans(np.array(spans, np.int32)))))
        p, w, k, d = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"part": pa.array(p, pa.int32()), "home": pa.array(w, pa.int32()), "kind": pa.array(k, pa.int32()), "data": pa.array(d, pa.binary())})

    return run


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Runs of window starts (row, first, after the last), those that touch put together."""
    if not len(spans):
        return np.zeros((0, 3), np.int32)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))].astype(np.int64)
    far = spans[:, 0] << 40
    reach = np.maximum.accumulate(far + spans[:, 2])
    new = np.r_[True, far[1:] + spans[1:, 1] > reach[:-1]]
    at = np.flatnonzero(new)
    stop = reach[np.r_[at[1:], len(spans)] - 1] - far[at]
    return np.stack([spans[at, 0], spans[at, 1], stop], 1).astype(np.int32)


def padded_words(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of `width` bytes (a multiple of 8), zeros behind; and as numbers that sort like them."""
    raw = np.frombuffer(b"".join(t[:width].ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
    return raw, raw.view(">u8").astype(np.uint64)


def neighbours(raw: np.ndarray, words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows and the LCP of each with the one before it, not beyond either's length."""
    order, _ = suffix_order(words)
    lcp = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 1 << 14):
        hi = min(lo + (1 << 14), len(order))
        differ = raw[order[lo:hi]] != raw[order[lo - 1 : hi - 1]]
        lcp[lo:hi] = np.where(differ.any(1), differ.argmax(1), raw.shape[1])
    if len(order):
        lcp[1:] = np.minimum(lcp[1:], np.minimum(lens[order[1:]], lens[order[:-1]]))
    return order, lcp


def repeated_windows(texts: list[bytes], offset: np.ndarray, window: int, depth: int) -> list[np.ndarray]:
    """Per distance of a window's start before its place: the segments whose window there is also in another segment.

    A segment is a text around a place at `offset`; its windows begin at 0 .. len - window.
    """
    n, lens = len(texts), np.array([len(t) for t in texts], np.int64)
    right = [t[o:] for t, o in zip(texts, offset.tolist(), strict=True)]
    left = [t[:o][::-1] for t, o in zip(texts, offset.tolist(), strict=True)]
    width = -(-window // 8) * 8
    by_right, lcp_r = neighbours(*padded_words(right, width), lens - offset)
    by_left, lcp_l = neighbours(*padded_words(left, -(-(window - depth) // 8) * 8 or 8), offset)
    last = lens - window
    out = []
    for d in range(window - depth + 1):
        live = np.flatnonzero((offset >= d) & (offset - d <= last))
        if len(live) < 2:
            out.append(live[:0])
            continue
        classes = []
        for order, lcp, reach in ((by_left, lcp_l, d), (by_right, lcp_r, window - d)):
            cls = np.empty(n, np.int64)
            cls[order] = np.cumsum(lcp < reach)
            classes.append(cls[live])
        both = classes[0] * (n + 1) + classes[1]
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        out.append(np.unique(live[order[np.r_[same, False] | np.r_[False, same]]]))
    return out


def _resolve(window: int, depth: int) -> Callable:
    """One part's segments and windows to the spans of repeated window starts, by home."""

    def run(rows: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        texts, offset, owner = [], [], []
        h, g, places = [], [], []
        for home, kind, data in zip(rows["home"].to_pylist(), rows["kind"].to_pylist(), rows["data"].to_pylist(), strict=True):
            if kind == SPANS:
                found.setdefault(home, []).append(unpack(data, (np.int32, 3))[0])
            elif kind == WINDOWS:
                x, y, p = unpack(data, (np.uint64, 1), (np.uint64, 1), (np.int32, 2))
                h.append(x[:, 0]), g.append(y[:, 0]), places.append(np.c_[np.full(len(p), home, np.int32), p])
            else:
                body = zstandard.ZstdDecompressor().decompress(data)
                n = int(np.frombuffer(body, np.int64, 1)[0])
                head = np.frombuffer(body, np.int32, 4 * n, 8).reshape(n, 4)
                at = 8 + 16 * n
                for r, s, o, size in head.tolist():
                    texts.append(body[at : at + size])
                    at += size
                    offset.append(o)
                    owner.append((home, r, s))
        hits = []
        if texts:
            off, own = np.array(offset, np.int64), np.array(owner, np.int32)
            for d, seg in enumerate(repeated_windows(texts, off, window, depth)):
                seg = seg[own[seg, 1] >= 0]
                if len(seg):
                    start = own[seg, 2] + off[seg] - d
                    hits.append(np.stack([own[seg, 0], own[seg, 1], start, start + 1], 1))
        if h:
            h, g, places = np.concatenate(h), np.concatenate(g), np.concatenate(places)
            order = np.lexsort((g, h))
            same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
            p = places[order[np.r_[same, False] | np.r_[False, same]]]
            p = p[p[:, 1] >= 0]
            hits.append(np.c_[p, p[:, 2] + 1])
        if hits:
            all_ = np.concatenate(hits)
            all_ = all_[np.argsort(all_[:, 0], kind="stable")]
            edge = np.flatnonzero(np.r_[True, np.diff(all_[:, 0]) != 0]) if len(all_) else np.zeros(0, int)
            for a, z in zip(edge.tolist(), np.r_[edge[1:], len(all_)].tolist(), strict=True) if len(all_) else ():
                found.setdefault(int(all_[a, 0]), []).append(all_[a:z, 1:])
        return pa.table({"home": pa.array(list(found), pa.int32()), "spans": C.binaries([pack(joined_spans(np.concatenate(x))) for x in found.values()])})

    return run


# ---------------------------------------------------------------- the cut


def cut_bytes(raw: bytes, spans: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """Bytes removed, runs removed, bytes kept; spans are runs of repeated window starts."""
    if not len(spans):
        return 0, 0, raw
    runs = joined_spans(np.stack([np.zeros(len(spans), np.int64), spans[:, 0], spans[:, 1] + window - 1], 1))
    kept, at = [], 0
    for _, a, z in runs.tolist():
        kept.append(raw[at:a])
        at = z
    kept.append(raw[at:])
    return int((runs[:, 2] - runs[:, 1]).sum()), len(runs), b"".join(kept)


def loose(rest: pa.Array) -> pa.Array:
    """The struct with fields that may be null, as a table read back has them."""
    return rest.cast(pa.struct([pa.field(f.name, f.type, True) for f in rest.type]))


def _finished(rest: pa.ChunkedArray | pa.Array, results: list[tuple[int, int, int, bytes]]) -> dict:
    n, gone, runs, kept = zip(*results, strict=True) if results else ((), (), (), ())
    sha = [hashlib.sha256(k).hexdigest() for k in kept]
    return {"rest": rest, "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array(sha, pa.string())}


def _cut(window: int) -> Callable:
    def run(key, docs: pa.Table, found: pa.Table) -> pa.Table:
        spans = joined_spans(np.concatenate([unpack(x, (np.int32, 3))[0] for x in found["spans"].to_pylist()] or [np.zeros((0, 3), np.int32)]))
        out = []
        for row, raw in zip(docs["row"].to_pylist(), docs["raw"].to_pylist(), strict=True):
            lo, hi = np.searchsorted(spans[:, 0], row, "left"), np.searchsorted(spans[:, 0], row, "right")
            out.append((len(raw), *cut_bytes(raw, spans[lo:hi, 1:], window)))
        return pa.table(_finished(docs["rest"], out))

    return run


def _all_or_nothing(window: int) -> Callable:
    """Texts that occur again whole: all bytes go, or none where a text is shorter than a window."""

    def run(batches):
        for batch in batches:
            raw = [x.as_py() for x in batch["raw"]]
            cols = _finished(loose(batch["rest"]), [(len(x), len(x), 1, b"") if len(x) >= window else (len(x), 0, 0, x) for x in raw])
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def _number(batches):
    n = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["home"], pa.array(np.arange(n, n + len(batch)), pa.int32()), batch["raw"], loose(batch["rest"])], ["home", "row", "raw", "rest"])
        n += len(batch)


def remove_repeated_bytes(df: DataFrame, text_col: str = "text", window: int = WINDOW, depth: int = DEPTH, batches: int = BATCHES, hot: int = HOT, part_bytes: int = PART) -> DataFrame:
    """Every row of df without the bytes of its text under a string of `window` bytes that also starts anywhere else.

    Returns df's columns but the text, then n_bytes, n_removed, n_spans, kept (binary) and kept_sha256.
    """
    assert depth % 8 == 0 and 16 <= depth < window
    spark = df.sparkSession
    parts = C.parts_for(spark, df, text_col, part_bytes)
    rest = [c for c in df.columns if c not in (text_col, *MADE)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.encode(text, "UTF-8").alias("raw"), F.struct(*rest, F.lit(0).alias(C.unused(rest, "filler"))).alias("rest"))
    ka, kb = C.row_keys("raw")
    docs = docs.select(ka, kb, "raw", "rest")
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema["rest"].dataType])
    out = T.StructType([T.StructField("rest", kept), *(T.StructField(x, T.LongType()) for x in MADE[:3]), T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])
    names = [F.col(f"rest.`{c}`").alias(c) for c in rest]
    family = Family(spark, parts, window, depth)
    with C.Scratch() as scratch, family:
        again = C.written(docs.groupBy("ka", "kb").agg(F.count("*").alias("n")).filter("n > 1").select("ka", "kb"), "again")
        repeats = again.count()
        mark = F.broadcast(again) if repeats <= BROADCAST_KEYS else again
        repeated = docs.join(mark, ["ka", "kb"], "left_semi")
        one = repeated.dropDuplicates(["ka", "kb"]).withColumn("rest", F.lit(None).cast(docs.schema["rest"].dataType))
        single = docs.join(mark, ["ka", "kb"], "left_anti")
        matched = scratch.keep(C.written(_matched(family, single.unionByName(one), batches, hot, out).filter("rest is not null"), "cut", "zstd"))
        whole = scratch.keep(C.written(repeated.select("raw", "rest").mapInArrow(C.tidy(_all_or_nothing(window)), out), "whole", "zstd"))
    return matched.unionByName(whole).select(*names, *MADE)


def _matched(family: Family, docs: DataFrame, batches: int, hot: int, out: T.StructType) -> DataFrame:
    spark, parts, window, depth = family.spark, family.parts, family.window, family.depth
    schema = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("row", T.IntegerType()), docs.schema["raw"], out["rest"]])
    homed = docs.select(F.pmod("kb", F.lit(parts)).cast("int").alias("home"), "raw", "rest").repartition(parts, "home")
    docs = family.bucketed(homed.mapInArrow(_number, schema), "home")
    step = -(-parts // batches)
    for i in range(0, parts, step):
        family.add(docs.filter((F.col("home") >= i) & (F.col("home") < i + step)), last=i + step >= parts)
    places = family.places[0]
    for more in family.places[1:]:
        places = places.unionByName(more)
    tags = spark.sparkContext.broadcast(hot_tags(places, hot))
    by_home = docs.select("home", "row", "raw").groupBy("home").cogroup(places.mapInArrow(_by_home, "home int, places binary").groupBy("home"))
    sent = by_home.applyInArrow(C.tidy_groups(_segments(parts, window, depth, tags)), SENT)
    spans = sent.groupBy("part").applyInArrow(C.tidy_groups(_resolve(window, depth)), "home int, spans binary")
    return docs.groupBy("home").cogroup(spans.groupBy("home")).applyInArrow(C.tidy_groups(_cut(window)), out)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
