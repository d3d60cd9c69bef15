import hashlib
import random
import zlib

import numpy as np
import pytest

from dossier_spark.llm import jpeg as J


def test_zigzag_and_transform():
    assert J.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and J.ZIGZAG[-1] == 63
    assert np.allclose(J.BASIS @ J.BASIS.T / J.SCALE**2, np.eye(64), atol=1e-5)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 40_000, 300_000])
def test_round_trip(n):
    raw = random.Random(n).randbytes(n)
    full = J.pad(raw)
    assert len(full) % 576 == 0 and len(full) > 0
    data = J.write_jpeg(full)
    p = J.read_jpeg(data)
    assert J.to_payloads(p.coefficients, len(full)).tobytes() == full
    assert J.rgb(p).shape == (1, p.high, p.wide, 3)
    # eleven scans: DC in two steps of all components, AC in two bands and a refinement of each
    _, scans = J.structure(J.parsed(data)[0])
    assert [([c for c, _ in s.parts], s.band, s.high, s.low) for s in scans] == [([0, 1, 2], (0, 0), 0, 1), ([0, 1, 2], (0, 0), 1, 0), *[([c], b, 0, 1) for c in range(3) for b in J.BANDS], *[([c], (1, 63), 1, 0) for c in range(3)]]


def slow(data, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(J, "_known", lambda *a: False)
        return J.read_jpeg(data)


@pytest.mark.parametrize("n", [100, 3000, 9000])
def test_bitwise_reading_agrees(n, monkeypatch):
    data = J.write_jpeg(J.pad(random.Random(n).randbytes(n)))
    fast = J.read_jpeg(data)
    for a, b in zip(fast.coefficients, slow(data, monkeypatch).coefficients):
        assert (a[:, :, 1:] != 0).all() and (a == b).all()


def test_together_or_alone():
    """Pictures read together are those read alone, also of several structures."""
    r = random.Random(5)
    full = [J.pad(r.randbytes(n)) for n in (10, 900, 900, 5000, 10, 900)]
    files = [J.write_jpeg(x) for x in full]
    assert files[1:3] == J.write_many(np.frombuffer(full[1] + full[2], np.uint8).reshape(2, -1))
    seen = {}
    for at, p in J.read_many(files):
        x = J.rgb(p)
        for j, i in enumerate(at):
            seen[i] = x[j]
    for i, data in enumerate(files):
        assert (seen[i] == J.rgb(J.read_jpeg(data))[0]).all()


class Out:
    """Bits of a scan, written symbol by symbol by the codes of a table."""

    def __init__(self, table):
        self.code, self.bits, self.done = {s: (n, c) for (n, c), s in table.items()}, [], []

    def put(self, v, n):
        self.bits += [v >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        n, c = self.code[s]
        self.put(c, n)

    def value(self, v):
        size = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def restart(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        self.done.append(np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00"))
        self.bits = []

    def body(self):
        self.restart()
        out = self.done[0]
        for i, x in enumerate(self.done[1:]):
            out += bytes([0xFF, 0xD0 + i % 8]) + x
        return out


def sparse_picture(every):
    """An ordinary progressive picture, 4:2:0, not a whole number of macroblocks, with zero runs, ends of band, and a DC
    scan of all components between restart markers: (file, coefficients)."""
    r = random.Random(every)
    high, wide = 40, 24
    shapes = [(6, 4), (3, 2), (3, 2)]
    coef = [np.zeros((a * b, 64), np.int32) for a, b in shapes]
    needed = [(5, 3), (3, 2), (3, 2)]
    for c, (rows, cols), (_, width) in zip(coef, needed, shapes):
        c[:, 0] = [r.randrange(-200, 200) for _ in range(len(c))]
        for i in (y * width + x for y in range(rows) for x in range(cols)):
            for k in r.sample(range(1, 64), r.choice([0, 0, 1, 3, 9])):
                c[i, k] = r.choice([-3, -1, 1, 2, 3])
    dc_table = {(4, s): s for s in range(10)}
    ac_table = {(8, i): s for i, s in enumerate([0xF0] + [r << 4 | s for r in range(15) for s in range(3)] + [0xF1, 0xF2])}
    dht = lambda key, t: bytes([key, *[sum(n == k for n, _ in t) for k in range(1, 17)], *[t[k] for k in sorted(t)]])
    frame = J.struct.pack(">BHHB", 8, high, wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", J.segment(J.DQT, bytes([0]) + b"\x01" * 64), J.segment(J.SOF2, frame), J.segment(J.DHT, dht(0, dc_table) + dht(0x10, ac_table))]
    if every:
        out.append(J.segment(J.DRI, every.to_bytes(2, "big")))
    orders = [J.mcu_order(*s, *x) for s, x in zip(shapes, J.SAMPLING)]
    for first in (True, False):
        b, before = Out(dc_table), [0, 0, 0]
        for m in range(6):
            if every and m and m % every == 0:
                b.restart()
                before = [0, 0, 0]
            for k, o in enumerate(orders):
                for i in o[m]:
                    v = int(coef[k][i, 0])
                    if first:
                        d, before[k] = (v >> 1) - before[k], v >> 1
                        b.symbol(abs(d).bit_length()), b.value(d)
                    else:
                        b.put(v & 1, 1)
        out += [J.scan_head((0, 1, 2), 0, (0, 0), 0 if first else 1, 1 if first else 0), b.body()]
    for k, (c, (rows, cols), (_, width)) in enumerate(zip(coef, needed, shapes)):
        order = [y * width + x for y in range(rows) for x in range(cols)]
        b, run = Out(ac_table), 0

        def ends(b, run):
            while run:
                n = run.bit_length() - 1
                b.symbol(n << 4), b.put(run - (1 << n), n)
                run = 0

        for n, i in enumerate(order):
            if every and n and n % every == 0:
                ends(b, run)
                b.restart()
                run = 0
            at, zeros = 1, 0
            for at in range(1, 64):
                v = int(c[i, at])
                if not v:
                    zeros += 1
                    continue
                ends(b, run)
                run = 0
                while zeros > 15:
                    b.symbol(0xF0)
                    zeros -= 16
                b.symbol(zeros << 4 | abs(v).bit_length()), b.value(v)
                zeros = 0
            if zeros:
                run += 1
        ends(b, run)
        out += [J.scan_head((k,), 0, (1, 63), 0, 0), b.body()]
    return b"".join([*out, b"\xff\xd9"]), coef


@pytest.mark.parametrize("every", [0, 1, 2, 5])
def test_ordinary_pictures(every):
    """Interleaved scans, restart markers, runs of zeros and of ends of band, and a size that is no whole macroblock."""
    data, coef = sparse_picture(every)
    p = J.read_jpeg(data)
    assert all((a[0] == b).all() for a, b in zip(p.coefficients, coef)) and J.rgb(p).shape == (1, 40, 24, 3)


def test_refinement():
    """Corrections, newly set coefficients, zero runs and ends of band in a refinement scan."""
    table = {(2, 0): 0x01, (2, 1): 0x11, (3, 4): 0x10, (3, 5): 0x00, (4, 12): 0xF0, (4, 13): 0x02}
    d = np.zeros((2, 64), np.int32)
    d[0, 2], d[1, 5] = 4, -4
    bits = np.array([int(x) for x in "01 1 1 101 101 1".replace(" ", "")], np.uint8)
    J.ac_refine(J.Bits(np.packbits(bits).tobytes()), d, range(2), table, (1, 63), 1)
    assert d[0, 1] == 0 and d[0, 2] == 6 and d[0, 3] == 2 and d[1, 5] == -6


def test_damage():
    data = J.write_jpeg(J.pad(b"x"))
    for bad in (b"", b"GIF89a", data[:-2], data[:40]):
        with pytest.raises(ValueError):
            J.read_jpeg(bad)


def test_frame(spark, sf, tmp_path):
    r = random.Random(2)
    rows = [(1, None, 5), (2, "", 5), (3, "x" * 576, 5), (4, "é🙂" * 5000, None), (5, "same", 1), (6, "same", 1), (None, "".join(chr(r.randrange(32, 5000)) for _ in range(3000)), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature int")
    got = {r.doc_id: r for r in J.media_columns(df).collect()}
    for doc, text, _ in rows:
        full = J.pad((text or "").encode())
        g = got[doc]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len((text or "").encode()), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert g.media_bytes == len(g.media) and g.media_sha256 == hashlib.sha256(g.media).hexdigest()
        assert all(len(t.rgb) == t.height * t.width * 3 for t in g.tensors)
    assert got[5].feature == got[6].feature and J.media_columns(df.limit(0)).count() == 0
    # the tensors as a table, read back
    path = f"file://{tmp_path}/tensors"
    J.media_columns(df).write.parquet(path)
    again = {r.doc_id: r.tensors for r in spark.read.parquet(path).collect()}
    assert again == {k: r.tensors for k, r in got.items()} and again[5] == again[6]
    docs = {r.doc_id: J.pad(r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = J.op2_progressive_jpeg(spark, sf).collect()
    assert len(out) == len(docs) and all(r.payload_sha256 == hashlib.sha256(docs[r.doc_id]).hexdigest() for r in out)


def test_long_text_spans_pictures():
    text = b"long words " * 400_000
    (media,) = J.store([text])
    (d,) = J.describe([media], False)
    assert d["payload_sha256"] == hashlib.sha256(J.pad(text)).hexdigest() and ";" in d["feature"]
