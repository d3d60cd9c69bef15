"""Shared pieces of the text operators: table access, scratch tables, and vectorised word hashing.

Word hashing works on the UTF-8 bytes of many texts at once, in numpy without a Python step per word: a word is
read in pieces of eight bytes, each mixed with its place, and runs of words are joined pair by pair, every join
mixed again. No step is linear in the bytes, so strings built to cancel in a polynomial do not collide here. Hashes
under two seeds are independent; where equality decides a result, both are compared.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier_spark.sources import files

SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCRATCH: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors. The table belongs
    to the Scratch around it, if there is one; else it lasts as long as the application."""
    out = files.written(df, name, compression)
    if (scratch := _SCRATCH.get()) is not None:
        scratch.made.append(out)
    return out


class Scratch:
    """Deletes at its end what written() made within it, but the tables kept, which pass to the Scratch around it. What is
    still to be computed then must read kept ones only. Each thread has its own."""

    def __enter__(self) -> Scratch:
        self.made, self.kept = [], []
        self.token = _SCRATCH.set(self)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.append(table)
        return table

    def __exit__(self, kind, error, trace) -> None:
        _SCRATCH.reset(self.token)
        outer = _SCRATCH.get()
        for t in self.made:
            if not any(t is k for k in self.kept):
                files.delete(t.sparkSession, t.scratch_path)
            elif outer is not None:
                outer.made.append(t)


def row_keys(*cols: str) -> tuple[Column, Column]:
    """Two independent 64-bit keys of a row's content: together its identity. Equal rows share them, null ids are fine."""
    return F.xxhash64(*cols).alias("ka"), F.xxhash64(F.lit(7), *reversed(cols)).alias("kb")


def unused(columns: list[str] | tuple[str, ...], name: str = "source_text") -> str:
    """A column name that is none of these."""
    while name in columns:
        name += "_"
    return name


def parts_for(spark: SparkSession, df: DataFrame, text_col: str, bytes_per_part: int = 16 << 20) -> int:
    """How many parts hold the texts of df at about bytes_per_part each, at least the shuffle width."""
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_per_part), 1)


# ---------------------------------------------------------------- memory of workers


def give_back() -> None:
    """Return freed memory to the system: idle Python workers stay, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator's tasks keep in this worker process for its next tasks, until a task of another operator begins here."""
    return _KEPT.setdefault(owner, {})


def forget(but: str = "") -> None:
    """Drop what the tasks of other operators have kept in this worker process."""
    others = [owner for owner in _KEPT if owner != but]
    for owner in others:
        del _KEPT[owner]
    if others:
        give_back()


def tidy(run: Callable, owner: str = "") -> Callable:
    """run (batches to batches), giving memory back at the end of a task, and before it what other operators have kept."""

    def inner(batches):
        forget(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def tidy_groups(run: Callable, every: int = 1) -> Callable:
    """run (a group to a table), giving memory back after each `every` groups. How many arguments it takes is run's own."""
    done = [0]

    def call(*group):
        forget()
        out = run(*group)
        done[0] += 1
        if done[0] % every == 0:
            give_back()
        return out

    if len(inspect.signature(run).parameters) == 1:
        return lambda table: call(table)
    if len(inspect.signature(run).parameters) == 2:
        return lambda a, b: call(a, b)
    return lambda key, a, b: call(key, a, b)


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to workers and back in Arrow batches of BATCH_ROWS rows at most: an executor holds some of them at once, outside
    its heap and in each worker. A setting of the session; a smaller one of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


# ---------------------------------------------------------------- numpy text kernels


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and n+1 offsets into them. Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def doc_slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [lo, hi) of texts of at most `limit` bytes together, one text at least."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed], np.uint64)))


ODD, ODD2 = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95)
PIECE_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte offsets) of words [^\\x20\\x09-\\x0D]+, and how many words each text has."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    inside = ~IS_SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offs] = True
    start = inside & cut[:-1]
    start[1:] |= inside[1:] & ~inside[:-1]
    end = inside & cut[1:]
    end[:-1] |= inside[:-1] & ~inside[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(s, offs))
    return s, e, counts


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word buf[s:e]."""
    if not len(s):
        return np.zeros(0, np.uint64)
    n = e - s
    room = np.concatenate([buf, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(buf) + 1,), "<u8", room, strides=(1,))  # the eight bytes from each place on
    key = seeded(2, seed)

    def piece(value, place):
        return mix(mix(value + key[0]) + mix(place.astype(np.uint64) * ODD + key[1]))

    out = piece(at8[s] & PIECE_MASKS[np.minimum(n, 8)], np.zeros(1, np.int64))
    more = (n - 1) // 8  # pieces after the first
    if more.any():
        long = np.flatnonzero(more)
        place = within(more[long]) + 1
        at = np.repeat(s[long], more[long]) + 8 * place
        rest = np.minimum(np.repeat(e[long], more[long]) - at, 8)
        value = piece(at8[at] & PIECE_MASKS[rest], place)
        cut = np.cumsum(more[long]) - more[long]
        out[long] += np.add.reduceat(value, cut)
    return mix(out + n.astype(np.uint64) * ODD2)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of what a stands for, followed by what b stands for."""
    return mix(a * ODD + b)


def run_hashes(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of words[at : at + length], whole runs only: runs of 1, 2, 4, ... words are joined from halves."""
    span, block, taken, out = 1, words, 0, np.full(len(at), length, np.uint64)
    while True:
        if length & span:
            out = join(out, block[at + taken])
            taken += span
        span *= 2
        if span > length:
            return out
        half = span // 2
        block = join(block[:-half], block[half:]) if len(block) > half else block[:0]


def short_runs(words: np.ndarray, at: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """Hashes of words[at : at + length] for lengths of `most` or less."""
    out = length.astype(np.uint64)
    for j in range(most):
        live = j < length
        step = join(out, words[np.minimum(at + j, max(len(words) - 1, 0))])
        out = step if live.all() else np.where(live, step, out)
    return out


def within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, end to end."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def binaries(arrays) -> pa.Array:
    return pa.array([a if isinstance(a, bytes) else a.tobytes() for a in arrays], pa.binary())
