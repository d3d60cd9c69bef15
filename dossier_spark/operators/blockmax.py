"""BM25 over blocks of chunks with upper bounds (block-max MaxScore).

A block is a run of chunks of one client, packed where they lie: no posting is ever shuffled. It holds its postings with the
greatest impact of each term over runs of LANE chunks. Document frequencies are added up per client and term from
one row a block, and come back as the weights of the query terms alone.

A search for the k best first scores one block of each client. The k-th score found there is a threshold that all
tasks get; a block whose terms cannot reach it together is passed over, and within a block only chunks are scored that hold
one of the terms the threshold cannot do without, and whose bound reaches it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier_spark.sources.files import written

LANE, DIGITS = 64, 6
NEAR = 2e-6  # scores are compared as rounded to DIGITS, bounds with this much room
CHUNKS = "client_id string, path string, page int, chunk_no int, tokens array<string>"
BLOCKS = "client_id string, block long, n int, total long, path array<string>, page array<int>, chunk_no array<int>, dl binary, at binary, term binary, tf binary, terms array<int>, dfs array<int>"


class Queries:
    """Query terms as arrays: a query's are number[ptr[i]:ptr[i + 1]], with how often each occurs."""

    def __init__(self, ids: list, vocabulary: list[str], ptr: np.ndarray, term: np.ndarray, qtf: np.ndarray):
        self.ids, self.vocabulary, self.ptr, self.term, self.qtf = ids, vocabulary, ptr, term, qtf


def gathered(terms: DataFrame) -> Queries:
    """(query_id, term, qtf) of a bounded number of rows."""
    t = terms.toArrow().combine_chunks()
    q = t["query_id"].combine_chunks().dictionary_encode()
    v = t["term"].combine_chunks().dictionary_encode()
    number, term, qtf = q.indices.to_numpy(), v.indices.to_numpy(), t["qtf"].to_numpy()
    order = np.lexsort((term, number))
    ptr = np.searchsorted(number[order], np.arange(len(q.dictionary) + 1))
    return Queries(q.dictionary.to_pylist(), v.dictionary.to_pylist(), ptr, term[order].astype(np.int32), qtf[order].astype(np.float64))


def packed(vocabulary, size: int) -> Callable:
    """Chunks, in order within a client, to blocks of at most `size` chunks of one client."""

    def run(batches: Iterator[pa.RecordBatch]):
        words = pa.array(vocabulary.value, pa.string())
        held, n, number = None, 0, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if len(held) < 2 * size:
                continue
            client = held["client_id"].combine_chunks().dictionary_encode().indices.to_numpy()
            last = np.flatnonzero(client != client[-1])
            keep = int(last[-1]) + 1 if len(last) else len(held) // size * size  # the last client may go on
            yield from cut(held.slice(0, keep), words, number)
            held = held.slice(keep)
        if held is not None and len(held):
            yield from cut(held, words, number)

    def cut(rows: pa.Table, words: pa.Array, number: int):
        rows = rows.combine_chunks()
        client = rows["client_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        edge = np.flatnonzero(np.r_[True, client[1:] != client[:-1]])
        for a, z in zip(edge.tolist(), np.r_[edge[1:], len(rows)].tolist(), strict=True):
            for lo in range(a, z, size):
                yield block(rows.slice(lo, min(size, z - lo)), words, number)

    def block(rows: pa.Table, words: pa.Array, number: int) -> pa.RecordBatch:
        tokens = rows["tokens"].combine_chunks()
        dl = np.diff(tokens.offsets.to_numpy()).astype(np.int32)
        code = pc.index_in(tokens.flatten(), words)
        known = code.is_valid().to_numpy(zero_copy_only=False)
        chunk = np.repeat(np.arange(len(rows)), dl)[known]
        pair, tf = np.unique(chunk * (len(words) + 1) + code.drop_null().to_numpy(), return_counts=True)
        chunk, term = pair // (len(words) + 1), (pair % (len(words) + 1)).astype(np.int32)
        at = np.searchsorted(chunk, np.arange(len(rows) + 1)).astype(np.int32)
        terms, dfs = np.unique(term, return_counts=True)
        one = lambda v, kind: pa.array([v], kind)
        raw = lambda v: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
        lists = [one(rows[c].to_pylist(), pa.list_(kind)) for c, kind in (("path", pa.string()), ("page", pa.int32()), ("chunk_no", pa.int32()))]
        cols = [rows["client_id"].combine_chunks().slice(0, 1), one(number, pa.int64()), one(len(rows), pa.int32()), one(int(dl.sum()), pa.int64()), *lists]
        cols += [raw(dl), raw(at), raw(term), raw(tf.astype(np.int32)), one(terms.tolist(), pa.list_(pa.int32())), one(dfs.tolist(), pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(cols, schema=SCHEMA)

    return run


SCHEMA = pa.schema(
    [("client_id", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("total", pa.int64()), ("path", pa.list_(pa.string())), ("page", pa.list_(pa.int32())), ("chunk_no", pa.list_(pa.int32()))]
    + [(x, pa.binary()) for x in ("dl", "at", "term", "tf")]
    + [("terms", pa.list_(pa.int32())), ("dfs", pa.list_(pa.int32()))]
)


def index(spark: SparkSession, tokenised: DataFrame, queries: Queries, size: int) -> DataFrame:
    """Blocks of the chunks with the weights of their client: adds avgdl and idf (struct<term, idf> of the query vocabulary)."""
    words = spark.sparkContext.broadcast(queries.vocabulary)
    chunks = tokenised.select(F.col("client_id").cast("string").alias("client_id"), "path", F.col("page").cast("int").alias("page"), F.col("chunk_no").cast("int").alias("chunk_no"), "tokens")
    chunks = chunks.sortWithinPartitions("client_id", "path", F.col("page").asc_nulls_first(), "chunk_no")
    blocks = written(chunks.mapInArrow(packed(words, size), BLOCKS).withColumn("block", F.monotonically_increasing_id()), "blocks")
    stats = blocks.groupBy("client_id").agg(F.sum("n").alias("n_chunks"), (F.sum("total") / F.sum("n")).alias("avgdl"))
    df = blocks.select("client_id", F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("client_id", "x.terms").agg(F.sum("x.dfs").alias("df"))
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = df.join(stats, "client_id").select("client_id", "n_chunks", "avgdl", F.struct(F.col("terms").alias("term"), idf.alias("idf")).alias("w"))
    # at most one entry for each word of the queries
    weights = one.groupBy("client_id").agg(F.first("n_chunks").alias("n_chunks"), F.first("avgdl").alias("avgdl"), F.collect_list("w").alias("idf"))
    return written(blocks.drop("terms", "dfs").join(weights, "client_id"), "index")


class Block:
    """A block's postings by chunk and by term, with impacts and their bounds. idf: the terms and their weights."""

    def __init__(self, row: dict, idf_of: tuple[np.ndarray, np.ndarray], k1: float, b: float, words: int):
        self.n = row["n"]
        dl, self.at, term, tf = (np.frombuffer(row[c], np.int32) for c in ("dl", "at", "term", "tf"))
        idf = np.zeros(words)
        idf[idf_of[0]] = idf_of[1]
        chunk = np.repeat(np.arange(self.n), np.diff(self.at))
        self.term = term
        self.impact = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[chunk] / row["avgdl"])) if len(term) else np.zeros(0)
        order = np.argsort(term, kind="stable")
        self.start = np.searchsorted(term[order], np.arange(words + 1))
        self.chunk, self.by_term = chunk[order], self.impact[order]
        lanes = -(-self.n // LANE)
        self.lane = np.arange(self.n) // LANE
        self.lane_max = np.zeros((words, lanes))
        if len(term):
            key = term[order].astype(np.int64) * lanes + self.lane[self.chunk]  # ascending: chunks are in order within a term
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            self.lane_max.reshape(-1)[key[first]] = np.maximum.reduceat(self.by_term, first)
        self.most = self.lane_max.max(1) if lanes else np.zeros(words)

    def whole(self, found: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The scores of these chunks, from all their postings."""
        size = self.at[found + 1] - self.at[found]
        flat = np.repeat(self.at[found], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.bincount(np.repeat(np.arange(len(found)), size), self.impact[flat] * weight[self.term[flat]], minlength=len(found))

    def scores(self, term: np.ndarray, qtf: np.ndarray, k: int | None = None, threshold: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that share a term with the query, with their scores, rounded: all, or with k those that can be among the k
        best and reach the threshold.

        Terms are added from the greatest bound down. Once those left cannot reach the threshold together, chunks fall away whose
        sum and the bounds of what is left in their lane stay below it; when few are left, they are scored from their own
        postings. Without a threshold, the k-th best of some chunks that are ahead after half of the bounds is one.
        """
        here = self.most[term] > 0
        term, qtf = term[here], qtf[here]
        if not len(term):
            return np.zeros(0, np.int64), np.zeros(0)
        bound = self.most[term] * qtf
        order = np.argsort(-bound)
        term, qtf = term[order], qtf[order]
        left = np.cumsum(bound[order][::-1])[::-1]  # what this and later terms can add at most
        if k is not None and left[0] < threshold - NEAR:
            return np.zeros(0, np.int64), np.zeros(0)
        weight = np.zeros(len(self.most))
        weight[term] = qtf
        acc, hit = np.zeros(self.n), np.zeros(self.n, bool)
        few = max(4 * (k or 0), self.n // 32)
        for j, (t, w) in enumerate(zip(term.tolist(), qtf.tolist(), strict=True)):
            if k is not None and j:
                if threshold <= 0 and self.n > few and left[j] < left[0] / 2:
                    ahead = np.argpartition(-acc, 2 * k)[: 2 * k] if self.n > 2 * k else np.arange(self.n)
                    threshold = float(np.sort(self.whole(ahead, weight))[-k]) if len(ahead) >= k else 0.0
                if 0 < left[j] < threshold - NEAR and j % 2 == 0:
                    rest = qtf[j:] @ self.lane_max[term[j:]]
                    found = np.flatnonzero(acc + rest[self.lane] >= threshold - NEAR)
                    if len(found) <= few:
                        return found, np.round(self.whole(found, weight), DIGITS)
            at = self.chunk[self.start[t] : self.start[t + 1]]
            acc[at] += self.by_term[self.start[t] : self.start[t + 1]] * w
            hit[at] = True
        found = np.flatnonzero(hit if k is None else hit & (acc >= threshold - NEAR))
        return found, np.round(acc[found], DIGITS)


def search(queries, k: int | None, k1: float, b: float) -> Callable:
    """Index rows (with thresholds by query, or none) to scored chunks: the k best of each block, or all."""

    def run(batches: Iterator[pa.RecordBatch]):
        q: Queries = queries.value
        for batch in batches:
            # one row as Python values at a time, its lists never: a batch may hold thousands of rows
            plain = batch.select([c for c in batch.schema.names if c not in ("path", "page", "chunk_no", "idf")])
            for number in range(batch.num_rows):
                row = plain.slice(number, 1).to_pylist()[0]
                weights = batch["idf"][number].values
                block = Block(row, (weights.field("term").to_numpy(), weights.field("idf").to_numpy()), k1, b, len(q.vocabulary))
                least = dict(zip(row["asked"] or [], row["threshold"] or [], strict=True)) if "asked" in row else {}
                who, what, score, scored = [], [], [], 0
                for i in range(len(q.ids)):
                    found, s = block.scores(q.term[q.ptr[i] : q.ptr[i + 1]], q.qtf[q.ptr[i] : q.ptr[i + 1]], k, least.get(i, 0.0))
                    scored += len(found)
                    if k is not None:
                        live = s > 0
                        found, s = found[live], s[live]
                        if len(found) > k:
                            best = np.lexsort((found, -s))[:k]
                            found, s = found[best], s[best]
                    if len(found):
                        who.append(np.full(len(found), i)), what.append(found), score.append(s)
                if not who:
                    continue
                who, what, score = (np.concatenate(x) for x in (who, what, score))
                take = lambda c, part: batch[c][number].values.take(pa.array(what[part]))
                for lo in range(0, len(who), 1 << 14):
                    part = slice(lo, lo + (1 << 14))
                    cols = [pa.array([row["client_id"]] * len(who[part]), pa.string()), pa.array(who[part], pa.int32())]
                    cols += [take("path", part), take("page", part), take("chunk_no", part), pa.array(score[part]), pa.array([scored] + [0] * (len(who[part]) - 1) if not lo else [0] * len(who[part]), pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["client_id", "asked", "path", "page", "chunk_no", "score", "pairs"])

    return run


FOUND = "client_id string, asked int, path string, page int, chunk_no int, score double, pairs long"


def named(spark: SparkSession, found: DataFrame, queries: Queries, kind: T.DataType) -> DataFrame:
    """asked (a number) to query_id; the list has one row a query of this block of queries."""
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(queries.ids)], T.StructType([T.StructField("asked", T.IntegerType()), T.StructField("query_id", kind)]))
    return found.join(F.broadcast(ids), "asked").drop("asked")


def scored(spark: SparkSession, tokenised: DataFrame, terms: DataFrame, k: int | None, k1: float, b: float, size: int) -> DataFrame:
    """(client_id, query_id, path, page, chunk_no, score, pairs) for query terms (query_id, term, qtf) of a bounded number:
    all chunks that share a term with a query, or with k those that may be among its client's k best. pairs adds up to the
    pairs of chunk and query that were scored."""
    q = gathered(terms)
    blocks = index(spark, tokenised, q, size)
    shared = spark.sparkContext.broadcast(q)
    if k is not None:
        seeds = blocks.groupBy("client_id").agg(F.max_by("block", "n").alias("block"))
        first = blocks.join(seeds, ["client_id", "block"], "left_semi").mapInArrow(search(shared, k, k1, b), FOUND)
        # the k-th best of the seed, for queries that have so many there
        kth = first.groupBy("client_id", "asked").agg(F.count("*").alias("n"), F.min("score").alias("threshold")).filter(F.col("n") >= k)
        least = kth.groupBy("client_id").agg(F.collect_list("asked").alias("asked"), F.collect_list("threshold").alias("threshold"))
        blocks = blocks.join(written(least, "thresholds"), "client_id", "left")
    return named(spark, blocks.mapInArrow(search(shared, k, k1, b), FOUND), q, terms.schema["query_id"].dataType)
