"""Phrase collocations by stripes.

A stripe is an associative counter: a prefix of words, and for each next word how often it follows. Round k counts
the phrases of k words as stripes of their first k - 1 (round 1: of the empty prefix). A task builds the stripes of a
few MB of text and sends them off; stripes of equal prefix are merged element by element. One merged stripe gives the
extensions of its prefix, their total (the empty prefix: all words of a language), and the greatest of their counts,
which decides whether the prefix is subsumed by a longer phrase.

A phrase that is counted `least` times has only such parts, so round k counts a phrase only if its first and its last
k - 1 words may be frequent. Tasks ask that of a Bloom filter of fixed size, whatever the corpus: it lets too much pass
at worst and loses nothing; the merged counts decide. Within a task a phrase is known by 128 bits, across tasks by its words.

Hot keys: a slice of text sends each phrase once, however often it occurs; the stripe of a frequent prefix is dealt
over SLOTS parts by its next words, and the parts' totals and maxima are joined afterwards. Ranks are cut within
tasks before languages come together.

Defined results: a null text is empty, a null language is `und` (together with rows that say so). Repeated rows count
each. Columns beside text and language are ignored. Without a phrase of `least` occurrences there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

LEAST, LONGEST, TOP = 100, 5, 2000
SLICE, SLOTS, PART, SENT = 4 << 20, 16, 8 << 20, 256  # bytes of text a slice and a part; parts a batch
SEGMENTS, SEGMENT_BITS = 256, 19  # the filter: 256 segments of 2^19 bits, 16 MB
BROADCAST_LANGS = 1 << 19
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
UNKNOWN = "und"

IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(BREAKS)] = True
IS_GAP = IS_BREAK.copy()
IS_GAP[[0x20, 0x09]] = True
STRIPES = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("next", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])
MERGED = "lang string, prefix string, next array<string>, n array<long>, total long, most long"


# ---------------------------------------------------------------- words and phrases of a slice of text


def words_of(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, the text each is in, and whether it and the next are neighbours within a piece."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, bool)
    edge = np.zeros(len(b) + 1, bool)
    edge[offs] = True
    word = ~IS_GAP[b]
    start, end = word & edge[:-1], word & edge[1:]
    start[1:] |= word[1:] & ~word[:-1]
    end[:-1] |= word[:-1] & ~word[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(offs, s, side="right") - 1
    breaks = np.zeros(len(b) + 1, np.int32)
    np.cumsum(IS_BREAK[b], out=breaks[1:])
    linked = np.zeros(len(s), bool)
    linked[:-1] = (doc[1:] == doc[:-1]) & (breaks[s[1:]] == breaks[e[:-1]])
    return s, e, doc, linked


def phrase_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray, lang: np.ndarray, k: int, seed: int) -> list[np.ndarray]:
    """For 1..k words: a hash of the language and of the words from each place on (past the end: of what is there)."""
    w = C.word_hashes(b, s, e, seed)
    out = [C.join(lang, w)]
    for j in range(1, k):
        out.append(C.join(out[-1][: len(w) - j], w[j:]))
    return out


def joined(b: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, k: int) -> pa.Array:
    """The k words from each first on, with one space between: strings cut from one gather."""
    n = len(first)
    if not n or not k:
        return pa.array([""] * n, pa.string())
    w = (first[:, None] + np.arange(k)).ravel()
    ln = e[w] - s[w] + 1  # with a space, the last of a phrase goes
    at = np.repeat(s[w], ln) + C.within(ln)
    flat = b[np.minimum(at, len(b) - 1)]
    ends = np.cumsum(ln)
    flat[ends - 1] = 0x20
    stop = ends[k - 1 :: k]
    keep = np.ones(len(flat), bool)
    keep[stop - 1] = False
    offs = np.r_[0, stop - np.arange(1, n + 1)].astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offs), pa.py_buffer(flat[keep].tobytes()))


def language_hashes(langs: list[str]) -> np.ndarray:
    raw = [x.encode() for x in langs]
    ends = np.cumsum([len(x) for x in raw])
    return C.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]].astype(np.int64), ends.astype(np.int64), 3) if raw else np.zeros(0, np.uint64)


# ---------------------------------------------------------------- the filter


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment and two bits in it."""
    seg = (h >> np.uint64(56)).astype(np.int64) % SEGMENTS
    mask = np.uint64((1 << SEGMENT_BITS) - 1)
    return seg, (h & mask).astype(np.int64), ((h >> np.uint64(24)) & mask).astype(np.int64)


def _hash_phrases(k: int) -> Callable:
    def run(batches):
        for batch in batches:
            buf, offs = C.text_buffers(batch["phrase"])
            s, e, doc, _ = words_of(buf, offs)
            lang = language_hashes(batch["lang"].to_pylist())
            first = np.searchsorted(doc, np.arange(len(batch)))
            h = phrase_hashes(buf, s, e, lang[doc], k, 1)[-1][first]
            seg = _bits(h)[0]
            yield pa.RecordBatch.from_arrays([pa.array(seg, pa.int32()), pa.array(h.view(np.int64))], ["seg", "h"])

    return run


def _segment(key, rows: pa.Table) -> pa.Table:
    bits = np.zeros(1 << SEGMENT_BITS, bool)
    _, a, z = _bits(rows["h"].to_numpy().view(np.uint64))
    bits[a] = bits[z] = True
    return pa.table({"seg": pa.array([key[0].as_py()], pa.int32()), "bits": C.binaries([np.packbits(bits, bitorder="little")])})


def may_be(phrases: DataFrame, k: int) -> np.ndarray:
    """The filter of (lang, phrase): at most 16 MB, whatever their number."""
    rows = phrases.mapInArrow(_hash_phrases(k), "seg int, h long").groupBy("seg").applyInArrow(C.tidy_groups(_segment, SEGMENTS), "seg int, bits binary").collect()
    out = np.zeros((SEGMENTS, 1 << SEGMENT_BITS >> 3), np.uint8)
    for r in rows:
        out[r["seg"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    seg, a, z = _bits(h)
    yes = (bits[seg, a >> 3] >> (a & 7).astype(np.uint8)) & 1 != 0
    at = np.flatnonzero(yes)
    yes[at] = (bits[seg[at], z[at] >> 3] >> (z[at] & 7).astype(np.uint8)) & 1 != 0
    return yes


# ---------------------------------------------------------------- counting


def _count(k: int, parts: int, filtered) -> Callable:
    """Stripes of the phrases of k words, slice by slice."""

    def run(batches):
        bits = filtered.value if filtered is not None else None
        packing = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            buf, offs = C.text_buffers(batch["text"])
            langs = batch["lang"].to_pylist()
            names = sorted(set(langs))
            code = np.searchsorted(np.array(names), np.array(langs)) if names else np.zeros(0, np.int64)
            of = language_hashes(names)
            for lo, hi in C.doc_slices(offs, SLICE):
                out = stripes(C.LOWER_AZ[buf[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo], code[lo:hi], of, k, bits)
                if out is None:
                    continue
                lang, prefix, slot, nexts, counts, cut = out
                part = ((prefix[1] + slot * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) % parts
                to = lambda v: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), v)
                rows = pa.RecordBatch.from_arrays([pa.array(np.array(names, object)[lang], pa.string()), prefix[0], to(nexts), to(pa.array(counts, pa.int64()))], schema=STRIPES)
                order = np.argsort(part, kind="stable")
                part, rows = part[order], rows.take(pa.array(order))
                edge = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
                spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
                for i in range(0, len(spans), SENT):
                    packs = [packing.compress(rows.take(pa.array(np.arange(x, y))).serialize()) for x, y in spans[i : i + SENT]]
                    yield pa.RecordBatch.from_arrays([pa.array(part[[x for x, _ in spans[i : i + SENT]]], pa.int32()), pa.array(packs, pa.binary())], ["part", "stripes"])

    return run


def stripes(b: np.ndarray, offs: np.ndarray, code: np.ndarray, of: np.ndarray, k: int, bits: np.ndarray | None):
    """Stripes of one slice, ordered by prefix and slot: language, prefix (words and hash), slot, and end to end the next words
    and counts with their cuts. None if there are none."""
    s, e, doc, linked = words_of(b, offs)
    at = np.arange(len(s) - k + 1) if len(s) >= k else np.zeros(0, np.int64)
    for j in range(k - 1):
        at = at[linked[at + j]]
    if not len(at):
        return None
    lang = code[doc]
    ha = phrase_hashes(b, s, e, of[lang], k, 1)
    if bits is not None:
        good = passes(bits, ha[k - 2])
        at = at[good[at] & good[at + 1]]
        if not len(at):
            return None
    hb = phrase_hashes(b, s, e, of[lang], k, 2)
    x, y = ha[-1][at], hb[-1][at]
    order = np.argsort(x, kind="stable")
    p, q = x[order], y[order]
    if ((p[1:] == p[:-1]) & (q[1:] != q[:-1])).any():
        order = np.lexsort((y, x))
        p, q = x[order], y[order]
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
    counts = np.diff(np.r_[new, len(p)])
    one = at[order[new]]  # a place of each phrase
    head, head2 = (ha[k - 2][one], hb[k - 2][one]) if k > 1 else (of[lang[one]], of[lang[one]])
    slot = C.word_hashes(b, s[one + k - 1], e[one + k - 1], 4) % np.uint64(SLOTS)
    by = np.lexsort((slot, head2, head))
    one, counts, head, head2, slot = one[by], counts[by], head[by], head2[by], slot[by]
    first = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (head2[1:] != head2[:-1]) | (slot[1:] != slot[:-1])])
    return lang[one[first]], (joined(b, s, e, one[first], k - 1), head[first]), slot[first], joined(b, s, e, one + k - 1, 1), counts, np.r_[first, len(one)]


def _merge(least: int) -> Callable:
    """Stripes of equal prefix added up; of the result, entries of `least` or more, with the total and the greatest of all."""

    def run(rows: pa.Table) -> pa.Table:
        unpacking = zstandard.ZstdDecompressor()
        rows = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(unpacking.decompress(x.as_py())), STRIPES) for x in rows["stripes"]], STRIPES).combine_chunks()
        nexts = rows["next"].combine_chunks()
        parent = np.repeat(np.arange(len(rows)), np.diff(nexts.offsets.to_numpy()))
        flat = pa.table({"lang": rows["lang"].take(pa.array(parent)), "prefix": rows["prefix"].take(pa.array(parent)), "next": nexts.flatten(), "n": rows["n"].combine_chunks().flatten()})
        flat = flat.group_by(["lang", "prefix", "next"]).aggregate([("n", "sum")])
        whole = flat.group_by(["lang", "prefix"], use_threads=False).aggregate([("next", "list"), ("n_sum", "list"), ("n_sum", "sum"), ("n_sum", "max")]).combine_chunks()
        nexts, counts = whole["next_list"].combine_chunks(), whole["n_sum_list"].combine_chunks()
        often = counts.flatten().to_numpy() >= least
        cut = np.r_[0, np.cumsum(often)][counts.offsets.to_numpy()]
        to = lambda v: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), v.filter(pa.array(often)))
        out = pa.table({"lang": whole["lang"], "prefix": whole["prefix"], "next": to(nexts.flatten()), "n": to(counts.flatten()), "total": whole["n_sum_sum"], "most": whole["n_sum_max"]})
        return out.filter(pa.array(np.diff(cut) > 0))

    return run


def counted(docs: DataFrame, k: int, parts: int, least: int, known: DataFrame | None) -> DataFrame:
    """Merged stripes of the phrases of k words; `known` are the frequent phrases of k - 1."""
    filtered = docs.sparkSession.sparkContext.broadcast(may_be(known, k - 1)) if known is not None else None
    return docs.mapInArrow(C.tidy(_count(k, parts, filtered)), "part int, stripes binary").groupBy("part").applyInArrow(C.tidy_groups(_merge(least if k > 1 else 1), 8), MERGED)


def frequent(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) of a round's stripes."""
    one = stripes.select("lang", "prefix", F.explode(F.arrays_zip("next", "n")).alias("x")).select("lang", "prefix", "x.next", F.col("x.n").alias("f"))
    return one.filter(F.col("f") >= least).select("lang", F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")).alias("phrase"), "f")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = C.parts_for(spark, docs, "text", PART)
    with C.Scratch() as scratch:
        rounds = [C.written(counted(docs, 1, parts, least, None), "stripes")]
        for k in range(2, longest + 1):
            rounds.append(C.written(counted(docs, k, parts, least, frequent(rounds[-1], least).select("lang", "phrase")), "stripes"))
        return scratch.keep(C.written(scored(rounds, least, top), "collocations"))


def scored(rounds: list[DataFrame], least: int, top: int) -> DataFrame:
    """Ranks from the rounds' stripes."""
    by_length = [frequent(r, least) for r in rounds]
    counts = by_length[0]
    for f in by_length[1:]:
        counts = counts.unionByName(f)
    words = C.written(rounds[0].groupBy("lang").agg(F.sum("total").alias("n")), "words")
    words = F.broadcast(words) if words.count() <= BROADCAST_LANGS else words  # a join by language would deal all rows by it
    out = None
    for k in range(2, len(rounds) + 1):
        phrases = by_length[k - 1]
        if k < len(rounds):  # phrases as long as this and one word longer, to either side
            right = rounds[k].groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("most").alias("f"))
            left = by_length[k].select("lang", F.expr("substring(phrase, locate(' ', phrase) + 1)").alias("phrase"), "f")
            most = right.unionByName(left).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
            phrases = phrases.join(most, ["lang", "phrase"], "left").filter("longer is null or longer < f").drop("longer")
        w = F.split("phrase", " ")
        cuts = F.array(*[F.struct(F.lit(j).alias("k"), F.array_join(F.slice(w, 1, j), " ").alias("head"), F.array_join(F.slice(w, j + 1, k - j), " ").alias("rest")) for j in range(1, k)])
        cut = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
        out = cut if out is None else out.unionByName(cut)
    l, r = (counts.select("lang", F.col("phrase").alias(x), F.col("f").alias(y)) for x, y in (("head", "l"), ("rest", "r")))  # noqa: E741
    out = out.join(l, ["lang", "head"]).join(r, ["lang", "rest"]).join(words, "lang")
    exact = "cast(1000 * cast(a as decimal(16, 0)) * cast(n as decimal(17, 0)) as decimal(38, 0)) div cast(cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)) as decimal(38, 0))"
    out = out.withColumn("score", F.expr(exact))
    best = out.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score").withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(C.table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op11_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') lang, row_number() over () d, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') w from pieces),
grams as (select lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) phrase from words, range(1, 6) t(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) f from grams group by all),
n as (select lang, sum(f)::hugeint n from f where k = 1 group by lang),
longer as (
  select lang, phrase, max(f) most from (
    select lang, regexp_replace(phrase, ' [^ ]*$', '') phrase, f from f where k > 2 and f >= 100
    union all select lang, regexp_replace(phrase, '^[^ ]* ', ''), f from f where k > 2 and f >= 100) group by all),
c as (select f.lang, f.k, f.phrase, f.f a, string_split(f.phrase, ' ') w from f left join longer using (lang, phrase) where f.k > 1 and f.f >= 100 and (most is null or 100 * most < 100 * f.f)),
cuts as (select lang, phrase, a, j, array_to_string(w[1 : j], ' ') head, array_to_string(w[j + 1 :], ' ') rest from c, range(1, 5) t(j) where j < k),
scores as (
  select cuts.lang, cuts.phrase, a, j, h.f l, r.f r, n, (1000::hugeint * a * n) // (h.f::hugeint * r.f) score
  from cuts join f h on h.lang = cuts.lang and h.phrase = head join f r on r.lang = cuts.lang and r.phrase = rest join n on n.lang = cuts.lang),
best as (select *, row_number() over (partition by lang, phrase order by score, j) b from scores),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from best where b = 1)
select lang, rank, phrase, a, l, r, n::bigint n, score::bigint score from ranked where rank <= 2000
"""
}
