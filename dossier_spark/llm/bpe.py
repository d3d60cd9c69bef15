"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding. A sequence of tokens is what BPE makes of its bytes exactly if every two neighbours are what
BPE makes of their joint bytes, so each prefix of a word has one valid sequence. The transducer follows
all open hypotheses at once: where the last token began, and the bytes since. Reading a byte extends the
hypotheses that still begin some token and adds the one whose last token ends here. What all hypotheses
share is emitted, so output lags input by less than the longest token. Sets of hypotheses are the states;
they and their arcs are made when first reached and kept in a table of bounded size; once it is full,
further states are made for the word at hand and not kept. A piece that is
itself a token is that token, as in the library whose ids are matched.

Decoding. Token bytes go through a UTF-8 state machine that keeps an unfinished character for the next block.

Defined results: null and empty texts have no tokens; equal rows give equal rows; texts of any length are
read whole. Ids, decoded texts and digests are columns added to the input's; input columns of the same
names are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common as C

OWNER = "bpe"
VOCABULARY = "byte_bpe_50k.tiktoken"
STATES, WORDS, LONG, ROWS = 200_000, 200_000, 48, 512


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.open = {t[:i] for t in ranks for i in range(1, len(t))}
        self.whole: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.ids: dict[tuple[int, bytes], int] = {}
        self.states: list[tuple] = []
        self.arcs: list[dict[int, tuple]] = []
        self.finals: list[tuple[int, ...]] = []
        self.intern((-1, b"", (-1,), (0,), (0,)))

    def intern(self, state: tuple) -> int:
        """The number of a state: the last token emitted, the bytes since, and for each place in them the token
        that ends there, where it starts, and which places still begin some token. The first two fix the rest.
        -1 if the table is full; such a state serves the word at hand only."""
        if (at := self.ids.get(state[:2])) is None:
            if len(self.states) >= self.max_states:
                return -1
            at = self.ids[state[:2]] = len(self.states)
            self.states.append(state)
            self.arcs.append({})
            self.finals.append(self.path(state[2], state[3], len(state[1])))
        return at

    @staticmethod
    def path(tokens: tuple, starts: tuple, at: int) -> tuple[int, ...]:
        out = []
        while at:
            out.append(tokens[at])
            at = starts[at]
        return tuple(out[::-1])

    def merged(self, data: bytes) -> list[int]:
        """BPE of a few bytes by its definition: join the pair of least rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose join made this one; itself twice if it is one byte."""
        if (known := self.split.get(token)) is None:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                _, i = min((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None and r < token)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self.split[token] = (self.ranks[parts[0]], self.ranks[parts[-1]])
        return known

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves the two tokens as they are: taking their joins back, latest first, at no time
        may the two neighbours at the border have had a join that comes before the next step of either."""
        if (known := self.pairs.get((a, b))) is not None:
            return known
        if len(self.pairs) > 2 * self.max_states:
            self.pairs.clear()
        out = self.pairs[a, b] = self._border_holds(a, b)
        return out

    def _border_holds(self, a: int, b: int) -> bool:
        if not (self.is_whole(b) and (a < 0 or self.is_whole(a))):
            return False
        if a < 0:
            return True
        rank, data, before = self.ranks.get, self.bytes_of, 1 << 60
        while True:
            join = rank(data[a] + data[b])
            if join is not None and join < before:
                return False
            left, right = len(data[a]) > 1, len(data[b]) > 1
            if not left and not right:
                return True
            # of equal joins the left one comes first, so a join at the border must be strictly before
            # the left token's and may equal the right token's
            if left and (a > b or not right):
                before, a = a, self.halves(a)[1]
            else:
                before, b = b + 1, self.halves(b)[0]

    def is_whole(self, token: int) -> bool:
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The state after one more byte, and the tokens that are certain now."""
        _, pending, tokens, starts, live = state
        longer, ranks = pending + bytes((byte,)), self.ranks
        n, token, start = len(longer), -1, -1
        for j in live:
            t = ranks.get(longer[j:])
            if t is not None and self.may_follow(tokens[j], t):
                token, start = t, j
                break
        if start < 0:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        starts = (*starts, start)
        still = [j for j in live if longer[j:] in self.open]
        tokens = (*tokens, token)
        if not still:
            return (token, b"", (token,), (0,), (0,)), self.path(tokens, starts, n)
        # the last place that the paths of all open hypotheses pass through
        shared = None
        for j in (n, *still):
            seen = {j}
            while j:
                j = starts[j]
                seen.add(j)
            shared = seen if shared is None else shared & seen
        cut = max(shared)
        if not cut:
            return (tokens[0], longer, tokens, starts, (*still, n)), ()
        to = (tokens[cut], longer[cut:], tokens[cut:], tuple(x - cut for x in starts[cut:]), tuple(j - cut for j in (*still, n)))
        return to, self.path(tokens, starts, cut)

    def encode(self, word: bytes) -> list[int]:
        if (token := self.ranks.get(word)) is not None:
            return [token]
        at, out, arcs = 0, [], self.arcs[0]
        for i, byte in enumerate(word):
            arc = arcs.get(byte)
            if arc is None:
                state, emitted = self.step(self.states[at], byte)
                to = self.intern(state)
                if to < 0:
                    return self._finish(word, i + 1, state, [*out, *emitted])
                arc = arcs[byte] = (to, emitted, self.arcs[to])
            at, emitted, arcs = arc
            if emitted:
                out += emitted
        out += self.finals[at]
        return out

    def _finish(self, word: bytes, i: int, state: tuple, out: list[int]) -> list[int]:
        """The rest of a word from a state outside the full table."""
        for byte in word[i:]:
            at = self.ids.get(state[:2], -1)
            arc = self.arcs[at].get(byte) if at >= 0 else None
            if arc is not None:
                state, emitted = self.states[arc[0]], arc[1]
            else:
                state, emitted = self.step(state, byte)
            out += emitted
        out += self.path(state[2], state[3], len(state[1]))
        return out


def _utf8_steps() -> dict[str, list[tuple[int, int, str]]]:
    """State -> (first byte, last byte, next state); '' accepts, n is n bytes to come, others restrict the next byte."""
    return {
        "": [(0x00, 0x7F, ""), (0xC2, 0xDF, "1"), (0xE0, 0xE0, "e0"), (0xE1, 0xEC, "2"), (0xED, 0xED, "ed"), (0xEE, 0xEF, "2"), (0xF0, 0xF0, "f0"), (0xF1, 0xF3, "3"), (0xF4, 0xF4, "f4")],
        "1": [(0x80, 0xBF, "")], "2": [(0x80, 0xBF, "1")], "3": [(0x80, 0xBF, "2")],
        "e0": [(0xA0, 0xBF, "1")], "ed": [(0x80, 0x9F, "1")], "f0": [(0x90, 0xBF, "2")], "f4": [(0x80, 0x8F, "2")],
    }


class Utf8:
    """Incremental UTF-8: feed() gives the text of complete characters and keeps the rest."""

    STEPS = {s: {b: to for lo, hi, to in rows for b in range(lo, hi + 1)} for s, rows in _utf8_steps().items()}

    def __init__(self):
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        start = next((i for i in range(len(data) - 1, max(-1, len(data) - 5), -1) if data[i] & 0xC0 != 0x80), len(data))
        state: str | None = ""
        for b in data[start:]:
            state = self.STEPS[state].get(b)
            if state is None:
                break
        cut = start if state else len(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encoder with a bounded table of words, and decoder, for one vocabulary."""

    def __init__(self, path: str, pattern: str, max_states: int = STATES, max_words: int = WORDS):
        self.transducer = t = Transducer(read_ranks(path), max_states)
        self.find = regex.compile(pattern).findall
        self.tokens = t.bytes_of
        pack = [struct.Struct(f"<{n}I").pack for n in range(9)]

        class Words(dict):
            """Known words; when full, they become the older half and are dropped if not met again."""

            older: dict[str, bytes] = {}

            def __missing__(self, word: str) -> bytes:
                if (packed := self.older.get(word)) is None:
                    ids = t.encode(word.encode())
                    packed = pack[len(ids)](*ids) if len(ids) < len(pack) else np.array(ids, "<u4").tobytes()
                if len(word) <= LONG:
                    if len(self) >= max_words:
                        self.older = dict(self)
                        self.clear()
                    self[word] = packed
                return packed

        self.words = Words()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self.find(text)))

    def decode_blocks(self, ids: bytes, block: int = 1 << 14) -> Iterator[str]:
        machine = Utf8()
        for i in range(0, len(ids), 4 * block):
            yield machine.feed(b"".join(map(self.tokens.__getitem__, np.frombuffer(ids[i : i + 4 * block], "<u4").tolist())))
        yield machine.end()


def codec(path: str, pattern: str, max_states: int = STATES, max_words: int = WORDS) -> Codec:
    """One codec for each worker process and vocabulary; it stays for the worker's next tasks of this operator."""
    key, known = (path, pattern, max_states, max_words), C.kept(OWNER)
    if key not in known:
        known[key] = Codec(*key)
    return known[key]


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """An array of lists from their values end to end."""
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def _encode(path: str, pattern: str, keep: tuple[str, ...], outputs: tuple[str, ...], tables: tuple[int, int]) -> Callable:
    def run(batches):
        c = codec(path, pattern, *tables)
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            made = {k: [] for k in ("n_tokens", *outputs)}
            for text in batch.column(len(keep)):
                ids = c.encode(text.as_py() or "")
                made["n_tokens"].append(len(ids) // 4)
                if "ids" in made:
                    made["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
                if "ids_sha256" in made:
                    made["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                if "decoded_sha256" in made or "decoded" in made:
                    digest, pieces = hashlib.sha256(), []
                    for piece in c.decode_blocks(ids):
                        digest.update(piece.encode())
                        pieces.append(piece)
                    made.get("decoded_sha256", []).append(digest.hexdigest())
                    made.get("decoded", []).append("".join(pieces) if "decoded" in made else None)
            made = {k: pa.array(v, pa.int64() if k == "n_tokens" else pa.string()) if k != "ids" else lists(v) for k, v in made.items()}
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), *made.values()], [*keep, *made])

    return run


TYPES = {"ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def encode(df: DataFrame, text_col: str = "text", outputs: tuple[str, ...] = ("ids",), path: str | None = None, pattern: str | None = None, tables: tuple[int, int] = (STATES, WORDS)) -> DataFrame:
    """df without its text, with n_tokens and the outputs asked for: ids, ids_sha256, decoded (through the decoder), decoded_sha256.

    `tables` bounds the states and words that a worker keeps; smaller ones leave memory to other stages and cost time.
    """
    import public_tokenizers

    path, pattern = path or default_path(), pattern or public_tokenizers.PATTERN
    made = ("n_tokens", *outputs)
    keep = tuple(c for c in df.columns if c != text_col and c not in made)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), *(T.StructField(o, TYPES[o]) for o in outputs)])
    spark_text = df[text_col].cast("string").alias(C.unused(keep))
    return df.select(*keep, spark_text).mapInArrow(C.tidy(_encode(path, pattern, keep, outputs, tables), OWNER), schema)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """df with column decoded: the text of its token ids."""
    import public_tokenizers

    path, pattern = path or default_path(), public_tokenizers.PATTERN
    keep = tuple(c for c in df.columns if c != "decoded")

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts = ["".join(c.decode_blocks(np.asarray(x.as_py() or [], "<u4").tobytes())) for x in batch[ids_col]]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    return df.select(*keep).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField("decoded", T.StringType())]))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, outputs=("ids_sha256", "decoded_sha256"))
