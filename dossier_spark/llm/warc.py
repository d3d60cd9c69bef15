"""WARC archives in Zstandard: writer and reader.

An archive begins with a skippable frame that holds the dictionary; every record is a frame of its own.
The reader loads that dictionary, finds each frame's end from its block headers, decodes one frame per
record and validates version, mandatory headers, block length, HTTP length and payload digest.

Records with equal payloads: the one with the largest page_id is the response, the others are revisits
that hold the HTTP header only and refer to it. Archives are rows of a Parquet table in the shared folder,
one row for each archive file (name, bytes), so that a lost executor costs only its unfinished archives.

Defined results: a null html is an empty payload; a null url gives no target header; a null page_id has
no number in its record id and comes back as null. Repeated rows each get a record; of equal payloads all
rows with the largest page_id are responses. Other input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SKIPPABLE = 0x184D2A5D
MAGIC = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES, DICT_BYTES, SAMPLES, HEAVY = 4 << 20, 16 << 10, 200, 100_000
RECORD_ID = "urn:page:"
DATE = "2024-01-01T00:00:00Z"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


class WarcError(ValueError):
    pass


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, response_id) -> bytes:
    """One record; a revisit if response_id names another page."""
    revisit = page_id != response_id
    name = lambda x: f"<{RECORD_ID}{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(response_id)}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(records: list[bytes]) -> bytes:
    samples = [r[: 16 << 10] for r in records[:SAMPLES]]
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few records to train on: their own bytes serve
        trained = (b"".join(samples)[:DICT_BYTES]).ljust(8, b"\n")
    c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(trained)), trained, *map(c.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at `at` ends, from its block headers."""
    if bytes(data[at : at + 4]) != MAGIC:
        raise WarcError(f"no frame at byte {at}")
    p = zstandard.get_frame_parameters(bytes(data[at : at + 18]))
    end = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    last = False
    while not last:
        if end + 3 > len(data):
            raise WarcError("truncated frame")
        head = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise WarcError("reserved block type")
        end += 3 + (1 if kind == 1 else size)
    end += 4 * p.has_checksum
    if end > len(data):
        raise WarcError("truncated frame")
    return end


def frames(archive: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, in order."""
    data = memoryview(archive)
    if len(data) < 8:
        raise WarcError("no dictionary frame")
    magic, size = struct.unpack("<II", data[:8])
    if magic != SKIPPABLE or 8 + size > len(data):
        raise WarcError("no dictionary frame")
    loaded = bytes(data[8 : 8 + size])
    if loaded[:4] == MAGIC:
        loaded = zstandard.ZstdDecompressor().decompress(loaded)
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(loaded))
    at = 8 + size
    while at < len(data):
        end = frame_end(data, at)
        try:
            yield d.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(str(e)) from e
        at = end


def headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:40]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def length_of(h: dict[str, str]) -> int:
    if not (value := h.get("content-length", "")).isdigit():
        raise WarcError("bad Content-Length")
    return int(value)


def page_of(name: str | None) -> int | None:
    inner = (name or "").strip("<>").removeprefix(RECORD_ID)
    return int(inner) if inner else None


def parse(raw: bytes) -> dict:
    """A validated record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("bad version line")
    h = headers(lines[1:])
    if missing := [x for x in MANDATORY if x.lower() not in h]:
        raise WarcError(f"missing {missing}")
    n = length_of(h)
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("block length differs from Content-Length")
    http, gap, body = rest[:n].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise WarcError("bad HTTP header")
    size = length_of(headers(http.split(b"\r\n")[1:]))
    kind, digest = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(body) != size or payload_digest(body) != digest):
        raise WarcError("payload differs from its length or digest")
    if kind not in ("response", "revisit") or (kind == "revisit" and (body or "warc-refers-to" not in h)):
        raise WarcError("bad record type")
    refers = page_of(h["warc-refers-to"]) if kind == "revisit" else None
    return {"page_id": page_of(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers, "payload": body if kind == "response" else None}


def _write(batches):
    open_, size, n = [], 0, 0

    def close():
        data = write_archive(open_)
        name = f"{hashlib.sha1(data).hexdigest()[:16]}.warc.zst"
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(open_)], pa.int64()), pa.array([data], pa.binary())], ["archive", "n_records", "content"])

    for batch in batches:
        for page_id, url, html, response in zip(*(batch[c] for c in ("page_id", "url", "html", "response_id")), strict=True):
            r = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), response.as_py())
            open_.append(r)
            size += len(r)
            if size >= ARCHIVE_BYTES:
                yield close()
                open_, size = [], 0
    if open_:
        yield close()


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
DDL = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary"}


def _read(fields: tuple[str, ...], rows: int = 256) -> Callable:
    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                block = []
                for raw in frames(content.as_py()):
                    block.append(parse(raw))
                    if len(block) >= rows:
                        yield pack(block)
                        block = []
                if block:
                    yield pack(block)

    def pack(block):
        return pa.RecordBatch.from_arrays([pa.array([r[f] for r in block], FIELDS[f]) for f in fields], list(fields))

    return run


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives (archive, n_records, content) of pages (page_id, url, html), written to the shared folder."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    ids = C.written(p.select("page_id", F.sha1("html").alias("sha")), "ids")
    groups = C.written(ids.groupBy("sha").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")), "groups")
    heavy, light = groups.filter(F.col("n") > HEAVY).drop("n"), groups.filter(F.col("n") <= HEAVY).drop("n")
    distinct = ids.distinct()
    if heavy.limit(1).count():
        # payloads of more than HEAVY pages: at most one in HEAVY of all pages, so they go to the pages; no task gathers one
        heavy = F.broadcast(heavy)
        joined = distinct.join(heavy, "sha").unionByName(distinct.join(heavy.select("sha"), "sha", "left_anti").join(light, "sha"))
    else:
        joined = distinct.join(light, "sha")
    decided = joined.select(F.col("page_id").alias("pid"), F.col("sha").alias("psha"), "response_id")
    both = p.join(decided, F.col("page_id").eqNullSafe(F.col("pid")) & (F.sha1("html") == F.col("psha")))
    return C.written(both.select("page_id", "url", "html", "response_id").mapInArrow(_write, "archive string, n_records long, content binary"), "warc")


def read_archives(archives: DataFrame, fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """One row for each record of the archives; a damaged archive fails the job with what is wrong."""
    return archives.select("content").mapInArrow(_read(fields), ", ".join(f"{f} {DDL[f]}" for f in fields))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(C.table(spark, sf_dir, "pages"))
    return read_archives(archives, ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"))


# The digest in base32: every five hex digits are four characters.
ORACLE_SQL = {
    "op10_warc": """select page_id, url, payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, (i * 5 + 1)::int, 5))::int >> b) & 31) + 1, 1)), '')), '') as payload_digest,
  case when page_id = response_id then 'response' else 'revisit' end as record_type, case when page_id <> response_id then response_id end as refers_to
  from (select page_id, url, strlen(html)::bigint as payload_bytes, sha1(html) as sha, max(page_id) over (partition by html) as response_id from (select page_id, url, coalesce(html, '') as html from pages))"""
}
