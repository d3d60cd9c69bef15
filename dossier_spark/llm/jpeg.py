"""Progressive JPEG media columns.

Writing. A payload's bytes become quantised coefficients, the unit this format stores without loss: byte b
of an AC place is the coefficient of size class 8 whose eight extra bits are b; the DC of a block is 256 + b, with
alternating sign along the scan. The picture is 4:2:0, its blocks fill Y, Cb and Cr in turn, and it is written in eleven
scans: the high bits of all DC, interleaved; the low bit of all DC, interleaved; of each component two spectral bands
of AC without their low bit; and of each component the low bit of all AC.

Reading. All scans are accumulated into one array of coefficients per component, as any decoder must: first scans set
the high bits, refinement scans add the low bit, scans of several components are taken macroblock by macroblock, and
restart markers begin anew. Then the blocks are inverse-transformed in numpy, chroma is upsampled to full resolution
and RGB tensors are formed. The transform is an exact sum of integers, so equal texts have equal tensors wherever
they are read.

Pictures of equal size are written, read and transformed together. Of scans whose codes are known in advance, as ours,
the places of all values are known too, and a scan of many pictures is one array; all others are read bit by bit.

Defined results: a null text is empty; empty payloads are padded like others (one unit of 576 bytes of 255).
Equal texts give equal values. Texts of any length are stored whole: a picture holds up to PIECE bytes, longer payloads
continue in further pictures, end to end. Input columns are returned unchanged, but the text, and those named like an
output, which are replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common as C

UNIT, PAD = 576, 255
SOI, SOF2, DHT, SOS, DQT, DRI, COM, EOI = 0xD8, 0xC2, 0xC4, 0xDA, 0xDB, 0xDD, 0xFE, 0xD9
SCAN_END = re.compile(b"\xff(?![\x00\xd0-\xd7])")
RESTART = re.compile(b"\xff[\xd0-\xd7]")
SAMPLING = ((2, 2), (1, 1), (1, 1))
DC_FIRST, DC_NEXT, AC_FIRST, EOB = 0x08, 0x09, 0x07, 0x00
DC_CODES = {(1, 0): DC_FIRST, (2, 2): DC_NEXT}


def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of each coefficient in scan order: along diagonals, turning at the edges."""
    cells = [(u + v, (u if (u + v) % 2 else v), u * 8 + v) for u in range(8) for v in range(8)]
    return np.array([c for *_, c in sorted(cells)])


ZIGZAG = zigzag()


# ---------------------------------------------------------------- layout


@dataclass(frozen=True)
class Layout:
    """Macroblocks of a picture of n payload bytes: 64 bytes a block, six blocks a macroblock."""

    wide: int
    high: int

    @classmethod
    def of(cls, n: int) -> Layout:
        m = max(1, -(-n // (64 * 6)))
        wide = m if m <= 16 else min(range(9, 17), key=lambda w: (w * -(-m // w), -w))
        return cls(wide, -(-m // wide))

    @property
    def blocks(self) -> tuple[int, int, int]:
        m = self.wide * self.high
        return 4 * m, m, m


@lru_cache(256)
def mcu_order(rows: int, cols: int, h: int, v: int) -> np.ndarray:
    """Raster numbers of a component's blocks, (macroblocks, v * h), in the order of interleaved scans."""
    return np.arange(rows * cols).reshape(rows // v, v, cols // h, h).swapaxes(1, 2).reshape(-1, v * h)


@lru_cache(256)
def dc_signs(wide: int, high: int) -> tuple[np.ndarray, ...]:
    """The sign of each block's DC, in raster order: alternating along the scan."""
    out = []
    for h, v in SAMPLING:
        order = mcu_order(high * v, wide * h, h, v).ravel()
        sign = np.empty(len(order), np.int16)
        sign[order] = 1 - 2 * (np.arange(len(order)) % 2)
        out.append(sign)
    return tuple(out)


def to_coefficients(payloads: np.ndarray) -> tuple[Layout, list[np.ndarray]]:
    """Of payloads (d, n): coefficients in scan order, (d, blocks, 64) of each component; blocks past the payload hold bytes PAD."""
    d, n = payloads.shape
    at = Layout.of(n)
    total = sum(at.blocks)
    b = np.full((d, total * 64), PAD, np.int16)
    b[:, :n] = payloads
    b = b.reshape(d, total, 64)
    # extra bits of size class 8: 128..255 stand for themselves, 0..127 for b - 255
    c = np.where(b >= 128, b, b - 255)
    c[:, :, 0] = 256 + b[:, :, 0]
    out, first = [], 0
    for n, sign in zip(at.blocks, dc_signs(at.wide, at.high), strict=True):
        part = c[:, first : first + n]
        part[:, :, 0] *= sign
        out.append(part)
        first += n
    return at, out


def to_payloads(coefficients: list[np.ndarray], n: int) -> np.ndarray:
    """(d, n) bytes of coefficients (d, blocks, 64)."""
    parts = []
    for c in coefficients:
        b = np.where(c >= 0, c, c + 255)
        b[:, :, 0] = np.abs(c[:, :, 0]) - 256
        parts.append(b.astype(np.uint8).reshape(len(c), -1))
    return np.concatenate(parts, 1)[:, :n]


# ---------------------------------------------------------------- writer


def value_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value, high ones first, along a new last axis."""
    return (values[..., None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8)


def as_bytes(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of bytes, filled with ones."""
    fill = -bits.shape[1] % 8
    return np.packbits(np.concatenate([bits, np.ones((len(bits), fill), np.uint8)], 1) if fill else bits, axis=1)


def stuffed(rows: np.ndarray) -> list[bytes]:
    """Entropy-coded segments of rows of bytes: a zero after each byte 255."""
    raw, n = np.ascontiguousarray(rows).tobytes(), rows.shape[1]
    return [raw[i : i + n].replace(b"\xff", b"\xff\x00") for i in range(0, len(raw), n)]


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


# Huffman tables: DC 0 with codes 0 and 10, AC 0 (first scans) and AC 1 (refinement) with the single code 0.
TABLES = segment(DHT, bytes([0x00, 1, 1, *[0] * 14, DC_FIRST, DC_NEXT, 0x10, 1, *[0] * 15, AC_FIRST, 0x11, 1, *[0] * 15, EOB]))
BANDS = ((1, 5), (6, 63))


def scan_head(components: tuple[int, ...], table: int, band: tuple[int, int], high: int, low: int) -> bytes:
    return segment(SOS, bytes([len(components), *(x for c in components for x in (c + 1, table << 4 | table)), *band, high << 4 | low]))


def dc_bits(parts: list[np.ndarray], at: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the two DC scans: differences of the halved values, and the low bits. Signs alternate, so a component's first
    value has size class 8 and all further differences have 9."""
    symbols, low = [], []
    for c, (h, v) in zip(parts, SAMPLING, strict=True):
        dc = c[:, mcu_order(at.high * v, at.wide * h, h, v).ravel(), 0].astype(np.int32)
        half = dc >> 1
        diff = np.diff(half, axis=1, prepend=0)
        diff[:, 1:] += 511 * (diff[:, 1:] < 0)
        bits = np.empty((*diff.shape, 11), np.uint8)
        bits[:, :, 0], bits[:, :, 1], bits[:, :, 2:] = 1, 0, value_bits(diff, 9)
        symbols.append(bits.reshape(len(dc), -1, h * v, 11))
        low.append((dc & 1).astype(np.uint8).reshape(len(dc), -1, h * v))
    every = np.concatenate(symbols, 2)  # (d, macroblocks, 6, 11)
    d = len(every)
    # the first value of each component is a code of one bit and eight more
    first = [every[:, 0, i, :] if i in (1, 2, 3) else np.concatenate([np.zeros((d, 1), np.uint8), every[:, 0, i, 3:]], 1) for i in range(6)]
    return np.concatenate([*first, every[:, 1:].reshape(d, -1)], 1), np.concatenate(low, 2).reshape(d, -1)


def write_many(payloads: np.ndarray) -> list[bytes]:
    """The pictures of payloads (d, n) of one length."""
    at, parts = to_coefficients(payloads)
    d, n = payloads.shape
    frame = struct.pack(">BHHB", 8, at.high * 16, at.wide * 16, 3) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(SAMPLING))
    out = [[b"\xff\xd8" + segment(COM, struct.pack(">Q", n)) + segment(DQT, bytes([0]) + b"\x01" * 64) + segment(SOF2, frame) + TABLES] * d]
    for bits, (high, low) in zip(dc_bits(parts, at), ((0, 1), (1, 0)), strict=True):
        out += [[scan_head((0, 1, 2), 0, (0, 0), high, low)] * d, stuffed(as_bytes(bits))]
    for i, c in enumerate(parts):
        half = np.where(c >= 0, c >> 1, -(-c >> 1))
        seven = np.where(half > 0, half, half + 127).astype(np.uint8)  # seven bits after the code 0: a byte
        for band in BANDS:
            out += [[scan_head((i,), 0, band, 0, 1)] * d, stuffed(seven[:, :, band[0] : band[1] + 1].reshape(d, -1))]
    for i, c in enumerate(parts):
        low = (c & 1).astype(np.uint8)  # of a magnitude as of its value
        low[:, :, 0] = 0  # the code of an end of band, then a correction bit for each coefficient
        out += [[scan_head((i,), 1, (1, 63), 1, 0)] * d, stuffed(np.packbits(low.reshape(d, -1), axis=1))]
    out.append([b"\xff\xd9"] * d)
    return [b"".join(x) for x in zip(*out, strict=True)]


def write_jpeg(payload: bytes) -> bytes:
    return write_many(np.frombuffer(payload, np.uint8)[None])[0]


# ---------------------------------------------------------------- reader


class Bits:
    """Bit by bit reading of an entropy-coded segment; past its end come ones."""

    def __init__(self, raw: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(raw, np.uint8)).tolist() + [1] * 64, 0

    def one(self) -> int:
        self.at += 1
        return self.bits[self.at - 1]

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.one()
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.one()
            if (s := table.get((n, code))) is not None:
                return s
        raise ValueError("bad Huffman code")

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def huffman(body: bytes) -> list[tuple[int, dict[tuple[int, int], int]]]:
    out, at = [], 0
    while at < len(body):
        key, counts, at = body[at], body[at + 1 : at + 17], at + 17
        table, code = {}, 0
        for n, k in enumerate(counts, 1):
            for _ in range(k):
                table[n, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        out.append((key, table))
    return out


def dc_scan(b: Bits, units: list[list[tuple[int, int]]], cs: list[np.ndarray], tables: list[dict], low: int) -> None:
    """First DC scan of macroblocks: units of (component, block)."""
    before = [0] * len(cs)
    for unit in units:
        for k, i in unit:
            before[k] += b.signed(b.symbol(tables[k]))
            cs[k][i, 0] = before[k] * (1 << low)


def dc_refine(b: Bits, units: list[list[tuple[int, int]]], cs: list[np.ndarray], low: int) -> None:
    for unit in units:
        for k, i in unit:
            cs[k][i, 0] |= b.one() << low


def ac_first(b: Bits, c: np.ndarray, order, table: dict, band: tuple[int, int], low: int) -> None:
    ss, se = band
    run = 0
    for i in order:
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            r, s = divmod(b.symbol(table), 16)
            if s:
                k += r
                c[i, k] = b.signed(s) * (1 << low)
            elif r < 15:
                run = (1 << r) + b.take(r) - 1
                break
            else:
                k += 15
            k += 1


def ac_refine(b: Bits, c: np.ndarray, order, table: dict, band: tuple[int, int], low: int) -> None:
    ss, se = band
    step, run = 1 << low, 0

    def correct(i, k):
        if b.one():
            c[i, k] += step if c[i, k] > 0 else -step

    for i in order:
        k = ss
        if not run:
            while k <= se:
                r, s = divmod(b.symbol(table), 16)
                new = 0
                if s:
                    new = step if b.one() else -step
                elif r < 15:
                    run = (1 << r) + b.take(r)
                    break
                while k <= se:
                    if c[i, k]:
                        correct(i, k)
                    elif r == 0:
                        break
                    else:
                        r -= 1
                    k += 1
                if new and k <= se:
                    c[i, k] = new
                k += 1
        if run:
            for k in range(k, se + 1):
                if c[i, k]:
                    correct(i, k)
            run -= 1


@dataclass
class Picture:
    """Pictures of one size: sizes, sampling, quantisers, and coefficients (d, blocks, 64) in scan order."""

    high: int
    wide: int
    sampling: list[tuple[int, int]]
    quantisers: list[np.ndarray]
    coefficients: list[np.ndarray]
    shapes: list[tuple[int, int]]
    comment: bytes

    @property
    def most(self) -> tuple[int, int]:
        return max(h for h, _ in self.sampling), max(v for _, v in self.sampling)


@dataclass(frozen=True)
class Scan:
    parts: tuple[tuple[int, int], ...]  # component, table numbers
    band: tuple[int, int]
    high: int
    low: int
    every: int  # macroblocks between restarts, 0 for none
    tables: dict


def parsed(data: bytes) -> tuple[bytes, list[bytes]]:
    """A JPEG taken apart: everything but its entropy-coded segments, and these."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, heads, bodies = 2, [], []
    while True:
        if at + 1 >= len(data) or data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        if marker == EOI:
            return b"".join(heads), bodies
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        heads.append(data[at : at + 2 + size])
        at += 2 + size
        if marker == SOS:
            end = SCAN_END.search(data, at)
            if end is None:
                raise ValueError("a scan without end")
            bodies.append(data[at : end.start()])
            at = end.start()


def structure(heads: bytes) -> tuple[Picture, list[Scan]]:
    """The frame and the scans that the header segments describe; coefficients are still to come."""
    at, tables, quants, comment, p, scans, every = 0, {}, {}, b"", None, [], 0
    idents: list[int] = []
    while at < len(heads):
        marker, size = heads[at + 1], int.from_bytes(heads[at + 2 : at + 4], "big")
        body = heads[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == COM:
            comment = body
        elif marker == DQT:
            i = 0
            while i < len(body):
                wide = 2 if body[i] >> 4 else 1
                quants[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                i += 1 + 64 * wide
        elif marker == DRI:
            every = int.from_bytes(body[:2], "big")
        elif marker == SOF2:
            _, high, width, n = struct.unpack(">BHHB", body[:6])
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
            idents, samp = [x[0] for x in parts], [(x[1] >> 4, x[1] & 15) for x in parts]
            hm, vm = max(h for h, _ in samp), max(v for _, v in samp)
            mw, mh = -(-width // (8 * hm)), -(-high // (8 * vm))
            p = Picture(high, width, samp, [quants[x[2]] for x in parts], [], [(mh * v, mw * h) for h, v in samp], comment)
        elif marker == DHT:
            tables.update(huffman(body))
        elif marker == SOS:
            n = body[0]
            parts = tuple((idents.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n))
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            scans.append(Scan(parts, (ss, se), approx >> 4, approx & 15, every, dict(tables)))
    if p is None:
        raise ValueError("no frame")
    p.comment = comment
    return p, scans


def read_many(pictures: list[bytes]) -> Iterator[tuple[list[int], Picture]]:
    """Pictures accumulated from all their scans, those of one structure together: (their places in the list, Picture)."""
    alike: dict[bytes, tuple[list[int], list[list[bytes]]]] = {}
    for i, data in enumerate(pictures):
        heads, bodies = parsed(data)
        at, held = alike.setdefault(heads, ([], []))
        at.append(i), held.append(bodies)
    for heads, (at, held) in alike.items():
        p, scans = structure(heads)
        p.coefficients = [np.zeros((len(at), a * b, 64), np.int32) for a, b in p.shapes]
        for s, bodies in zip(scans, zip(*held, strict=True), strict=True):
            if not _known(p, s, bodies):
                for j, body in enumerate(bodies):
                    _accumulate(p, j, s, body)
        yield at, p


def read_jpeg(data: bytes) -> Picture:
    """One picture; its coefficients are (1, blocks, 64)."""
    return next(read_many([data]))[1]


def _known(p: Picture, s: Scan, bodies: tuple[bytes, ...]) -> bool:
    """Read a scan of all pictures at once if its codes are known in advance; False if they are not."""
    if s.every:
        return False
    tables = [s.tables.get(t >> 4 if s.band[0] == 0 else 0x10 | t & 15) for _, t in s.parts]
    if s.band[0] == 0:
        if tuple(p.sampling) != SAMPLING or [c for c, _ in s.parts] != [0, 1, 2] or not (s.high or all(t == DC_CODES for t in tables)):
            return False
    elif len(tables[0]) != 1 or (1, 0) not in tables[0] or _needed(p, s.parts[0][0]) != p.shapes[s.parts[0][0]]:
        return False
    raw = [b.replace(b"\xff\x00", b"\xff") for b in bodies]
    n = len(raw[0])
    if any(len(r) != n for r in raw):
        return False
    rows = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), n)
    if s.band[0] == 0:
        return _known_dc(p, s, rows)
    comp, (ss, se) = s.parts[0][0], s.band
    c, code, band = p.coefficients[comp], tables[0][1, 0], se - ss + 1
    part = c[:, :, ss : se + 1]
    if not s.high:
        size = code
        if not 0 < size < 16 or n * 8 < part[0].size * (1 + size):
            return False
        if size == 7:  # code and bits fill a byte
            v = rows[:, : part[0].size].astype(np.int32)
            if (v > 127).any():
                return False
        else:
            bits = np.unpackbits(rows, axis=1)[:, : part[0].size * (1 + size)].reshape(len(rows), -1, 1 + size)
            if bits[:, :, 0].any():
                return False
            v = bits[:, :, 1:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1))
        v = np.where(v >= 1 << (size - 1), v, v - (1 << size) + 1) * (1 << s.low)
        c[:, :, ss : se + 1] = v.reshape(part.shape)
        return True
    if code != EOB or n * 8 < c.shape[1] * (1 + band) or not part.all():
        return False
    # nothing new in any block: the end of band, then a correction bit for each place
    bits = np.unpackbits(rows, axis=1)[:, : c.shape[1] * (1 + band)].reshape(len(rows), c.shape[1], 1 + band)
    if bits[:, :, 0].any():
        return False
    add = bits[:, :, 1:].astype(np.int32) << s.low
    c[:, :, ss : se + 1] = part + np.where(part > 0, add, -add)
    return True


def _known_dc(p: Picture, s: Scan, rows: np.ndarray) -> bool:
    """Interleaved DC of 4:2:0: one bit a block, or a size of 8 for the first block of a component and 9 for all others."""
    orders = [mcu_order(r, c, h, v) for (r, c), (h, v) in zip(p.shapes, p.sampling, strict=True)]
    m, d = len(orders[0]), len(rows)
    bits = np.unpackbits(rows, axis=1)
    if s.high:
        if bits.shape[1] < 6 * m:
            return False
        each = bits[:, : 6 * m].reshape(d, m, 6).astype(np.int32) << s.low
        for c, o, (lo, hi) in zip(p.coefficients, orders, ((0, 4), (4, 5), (5, 6)), strict=True):
            c[:, o.ravel(), 0] |= each[:, :, lo:hi].reshape(d, -1)
        return True
    if bits.shape[1] < 60 + 66 * (m - 1):
        return False
    every = np.zeros((d, m, 6, 11), np.uint8)
    every[:, 0, :, 0] = 1
    at = 0
    for i in range(6):
        if i in (1, 2, 3):
            every[:, 0, i] = bits[:, at : at + 11]
            at += 11
        else:
            if bits[:, at].any():
                return False
            every[:, 0, i, 3:] = bits[:, at + 1 : at + 9]
            at += 9
    every[:, 1:] = bits[:, 60 : 60 + 66 * (m - 1)].reshape(d, m - 1, 6, 11)
    if not every[..., 0].all() or every[..., 1].any():
        return False
    value = every[..., 2:].astype(np.int32) @ (1 << np.arange(8, -1, -1))
    first = value[:, 0, [0, 4, 5]]  # of eight bits
    value = np.where(value >= 256, value, value - 511)
    value[:, 0, [0, 4, 5]] = np.where(first >= 128, first, first - 255)
    for c, o, (lo, hi) in zip(p.coefficients, orders, ((0, 4), (4, 5), (5, 6)), strict=True):
        c[:, o.ravel(), 0] = np.cumsum(value[:, :, lo:hi].reshape(d, -1), axis=1) * (1 << s.low)
    return True


def _needed(p: Picture, comp: int) -> tuple[int, int]:
    """Rows and columns of blocks that a scan of this component alone covers: those that the picture needs."""
    (h, v), (hm, vm) = p.sampling[comp], p.most
    return -(-(-(-p.high * v // vm)) // 8), -(-(-(-p.wide * h // hm)) // 8)


def _accumulate(p: Picture, j: int, s: Scan, body: bytes) -> None:
    """Read a scan of picture j bit by bit, from restart to restart."""
    cs = [p.coefficients[c][j] for c, _ in s.parts]
    if len(s.parts) > 1:
        orders = [mcu_order(*p.shapes[c], *p.sampling[c]) for c, _ in s.parts]
        units = [[(k, int(i)) for k, o in enumerate(orders) for i in o[m]] for m in range(len(orders[0]))]
    else:
        comp = s.parts[0][0]
        rows, cols = _needed(p, comp)
        units = [[(0, int(i))] for i in (np.arange(rows)[:, None] * p.shapes[comp][1] + np.arange(cols)[None, :]).ravel()]
    pieces = RESTART.split(body) if s.every else [body]
    step = s.every or len(units)
    for n, piece in enumerate(pieces):
        some = units[n * step : (n + 1) * step]
        b = Bits(piece.replace(b"\xff\x00", b"\xff"))
        if s.band[0] == 0:
            dc_refine(b, some, cs, s.low) if s.high else dc_scan(b, some, cs, [s.tables[t >> 4] for _, t in s.parts], s.low)
        else:
            (ac_refine if s.high else ac_first)(b, cs[0], [i for ((_, i),) in some], s.tables[0x10 | s.parts[0][1] & 15], s.band, s.low)


def cosines() -> np.ndarray:
    """Rows are the places of a line, columns the frequencies of the orthonormal inverse transform."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)


SCALE = 1 << 20
# From coefficients in scan order to samples in raster order, in whole numbers: sums of them are exact in any order.
BASIS = np.rint(np.einsum("xu,yv->uvxy", cosines(), cosines()).reshape(64, 64)[ZIGZAG] * SCALE)


def planes(p: Picture) -> list[np.ndarray]:
    """Sample planes (d, rows, columns) of each component: dequantised, inverse-transformed, shifted and clipped."""
    out = []
    for c, q, (rows, cols) in zip(p.coefficients, p.quantisers, p.shapes, strict=True):
        x = (c * q).reshape(-1, 64).astype(np.float64) @ BASIS
        x = np.clip(np.floor(x / SCALE + 128.5), 0, 255).astype(np.uint8)
        out.append(x.reshape(len(c), rows, cols, 8, 8).swapaxes(2, 3).reshape(len(c), rows * 8, cols * 8))
    return out


def rgb(p: Picture) -> np.ndarray:
    """(d, height, width, 3) tensor of bytes: chroma repeated to full resolution, then converted."""
    hm, vm = p.most
    y, cb, cr = (np.repeat(np.repeat(x, vm // v, axis=1), hm // h, axis=2)[:, : p.high, : p.wide].astype(np.int32) for x, (h, v) in zip(planes(p), p.sampling, strict=True))
    cb -= 128
    cr -= 128
    # in 65536ths
    out = np.empty((*y.shape, 3), np.uint8)
    for i, part in enumerate(((91881 * cr + 32768 >> 16), (-22554 * cb - 46802 * cr + 32768 >> 16), (116130 * cb + 32768 >> 16))):
        out[..., i] = np.clip(y + part, 0, 255)
    return out


# ---------------------------------------------------------------- columns


def pad(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (-len(raw) % UNIT or (UNIT if not raw else 0))


def features_of(x: np.ndarray) -> list[str]:
    """Of pictures (d, height, width, 3): size, and the mean of each channel in four horizontal bands, in hundredths."""
    d, high, wide = x.shape[:3]
    edges = np.linspace(0, high, 5).astype(int)
    lines = x.sum(axis=2, dtype=np.int64)
    means = np.concatenate([lines[:, a:b].sum(axis=1) * 100 // max(1, (b - a) * wide) for a, b in zip(edges[:-1], edges[1:], strict=True)], 1)
    return [f"{wide}x{high}:" + ",".join(map(str, row)) for row in means.tolist()]


PIECE = 1 << 21  # bytes of payload in a picture, cut to whole units
TOGETHER = 1 << 19  # bytes of payload that are written or read together


def runs(sizes: list[int]) -> Iterator[list[int]]:
    """Numbers of items of equal size, TOGETHER bytes at a time."""
    by: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        by.setdefault(n, []).append(i)
    for n, at in by.items():
        step = max(1, TOGETHER // max(1, n))
        yield from (at[lo : lo + step] for lo in range(0, len(at), step))


def store(raws: list[bytes]) -> list[bytes]:
    """The media of each text's bytes: a JPEG for each piece of its payload, end to end."""
    pieces, owner, step = [], [], PIECE // UNIT * UNIT
    for i, raw in enumerate(raws):
        full = pad(raw)
        for lo in range(0, len(full), step):
            pieces.append(full[lo : lo + step]), owner.append(i)
    files: list[bytes] = [b""] * len(pieces)
    for at in runs([len(x) for x in pieces]):
        for i, data in zip(at, write_many(np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(len(at), -1)), strict=True):
            files[i] = data
    out: list[list[bytes]] = [[] for _ in raws]
    for i, data in zip(owner, files, strict=True):
        out[i].append(data)
    return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def pictures(media: bytes) -> Iterator[bytes]:
    """The JPEGs of a stored value, in order."""
    at = 0
    while at < len(media):
        nxt = media.find(b"\xff\xd9\xff\xd8", at)
        end = nxt + 2 if nxt >= 0 else len(media)
        yield media[at:end]
        at = end


def describe(media: list[bytes], tensors: bool) -> list[dict]:
    """What is read from each stored value: payload digests, features of its tensors, and with `tensors` these themselves."""
    files, owner = [], []
    for i, m in enumerate(media):
        for data in pictures(m):
            files.append(data), owner.append(i)
    got: list[tuple] = [()] * len(files)
    for some in runs([len(x) // 256 * 256 for x in files]):
        for at, p in read_many([files[i] for i in some]):
            n = struct.unpack(">Q", p.comment)[0]
            payload, x = to_payloads(p.coefficients, n).tobytes(), rgb(p)
            for j, (k, feature) in enumerate(zip(at, features_of(x), strict=True)):
                got[some[k]] = (payload[j * n : (j + 1) * n], feature, {"height": x.shape[1], "width": x.shape[2], "rgb": x[j].tobytes()} if tensors else None)
    parts: list[list[tuple]] = [[] for _ in media]
    for i, one in zip(owner, got, strict=True):
        parts[i].append(one)
    out = []
    for m, mine in zip(media, parts, strict=True):
        payload = b"".join(x[0] for x in mine)
        row = {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": ";".join(x[1] for x in mine)}
        out.append(row | ({"tensors": [x[2] for x in mine]} if tensors else {}))
    return out


KINDS = {"payload_bytes": (pa.int64(), T.LongType()), "payload_sha256": (pa.string(), T.StringType()), "tail_crc32": (pa.int64(), T.LongType()), "media_bytes": (pa.int64(), T.LongType()), "media_sha256": (pa.string(), T.StringType()), "feature": (pa.string(), T.StringType())}
TENSOR = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])
TENSORS = T.ArrayType(T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())]))


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together, one row at least."""
    yield from C.doc_slices(np.r_[0, np.cumsum(sizes)], limit)


def _encode(keep: tuple[str, ...]) -> Callable:
    def run(batches):
        for batch in batches:
            buf, offs = C.text_buffers(batch.column(len(keep)))
            for lo, hi in C.doc_slices(offs, 4 << 20):
                raws = [buf[a:z].tobytes() for a, z in zip(offs[lo:hi], offs[lo + 1 : hi + 1], strict=True)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(map(len, raws), pa.int64()), pa.array(store(raws), pa.binary())], [*keep, "n_bytes", "media"])

    return run


def _decode(keep: tuple[str, ...], tensors: bool, media_col: str) -> Callable:
    kinds = {k: v[0] for k, v in KINDS.items()} | ({"tensors": pa.list_(TENSOR)} if tensors else {})

    def run(batches):
        for batch in batches:
            sizes = np.array([len(m.as_buffer()) for m in batch[media_col]], np.int64)
            for lo, hi in slices(sizes, (1 if tensors else 4) << 20):
                part = batch.slice(lo, hi - lo)
                rows = describe(part[media_col].to_pylist(), tensors)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), *(pa.array([r[k] for r in rows], t) for k, t in kinds.items())], [*keep, *kinds])

    return run


def encode(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df without its text, with n_bytes (of the text) and media, its stored form."""
    keep = tuple(c for c in df.columns if c not in (text_col, "n_bytes", "media"))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return df.select(*keep, df[text_col].cast("string").alias(C.unused(keep))).mapInArrow(_encode(keep), schema)


def decode(df: DataFrame, media_col: str = "media", tensors: bool = True, keep_media: bool = False) -> DataFrame:
    """df with what is read from its media: digests of the payload and the media, features, and with `tensors` the
    full-resolution RGB tensors. The media stay if keep_media."""
    made = (*KINDS, *(("tensors",) if tensors else ()))
    keep = tuple(c for c in df.columns if c not in made and (keep_media or c != media_col))
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(k, v[1]) for k, v in KINDS.items()), *([T.StructField("tensors", TENSORS)] if tensors else [])])
    return df.select(*dict.fromkeys((*keep, media_col))).mapInArrow(_decode(keep, tensors, media_col), schema)


def media_columns(df: DataFrame, text_col: str = "text", tensors: bool = True) -> DataFrame:
    """df without its text, with its media, their digests and, with `tensors`, the RGB tensors read back from them. The
    media are written to the shared folder and read from there."""
    stored = C.written(encode(df, text_col), "media", "zstd")
    return decode(stored, tensors=tensors, keep_media=tensors)


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(C.table(spark, sf_dir, "documents").select("doc_id", "text"), tensors=False)
