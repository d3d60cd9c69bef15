"""The trie of common conversation beginnings, from sorted sequences and their LCPs.

A conversation is the sequence of 16-byte digests of its turns. Sequences are sorted over the whole table into blocks;
in a block the LCPs of neighbours (in turns) get a sparse table of minima. Each distinct prefix, a row and a depth, then
finds its members by itself: two binary searches over the table, one to the left and one to the right, give the interval
of rows that share so many turns. No stack is kept, so all prefixes of a block are searched at once.

Blocks see the sequences just before and after them. A node whose interval reaches over a block's border, at most one
for each turn of the bordering row, is sent as a part; parts are added up by the digest of their prefix. All figures
are sums over rows or block-local nodes, so that parts add:
  children   nodes that begin in the block, counted at their parent
  leaves     sequences that begin, less those that the next sequence continues
  saved      members times words for each node, less the words once where the node begins
So a first turn that a third of all conversations share costs one part in each of its blocks.

Bounds: a block holds about BLOCK_BYTES of digests; a conversation is one value, of 16 bytes a turn. The ids that end
at one node over many blocks are digested by one task, as SHA-256 is a chain; it streams them, in sorted order.

Defined results: a null conversation id names no conversation, such rows are left out; null roles and texts are empty;
null turns come first, turns of equal number are ordered by the digest of role and text; repeated rows are turns
of their own. A table without conversations has no nodes, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BLOCK_BYTES = 8 << 20
FAMILY, DEALT = 20, 4  # a conversation shares the first crc32 % DEALT turns of its family's first
WIDTH = 16
NONE = hashlib.sha256(b"").hexdigest()
FIGURES = ("n_convs", "n_children", "n_leaves", "saved_tokens")
ROWS = "kind string, block int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


# ---------------------------------------------------------------- sequences


def turn_digest(role: Column, text: Column) -> Column:
    r, t = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.md5(F.encode(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), "UTF-8")))


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) in order; a turn is (turn, digest, words)."""
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    t = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("digest"), words.alias("words")).alias("t"))
    return t.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(seqs: DataFrame, family: int = FAMILY, dealt: int = DEALT) -> DataFrame:
    """Every conversation with its first turns taken from its family's first conversation, if that is there."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % dealt).cast("int")
    heads = seqs.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, dealt - 1).alias("head"))
    all_ = seqs.withColumn("h", h).withColumn("first", F.col("conv_id") - F.col("conv_id") % family).join(heads, "first", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    shared = F.slice(F.coalesce("head", F.slice("turns", 1, F.lit(0))), F.lit(1), F.col("h"))
    return all_.select("conv_id", F.concat(shared, own).alias("turns"))


def packed(seqs: DataFrame) -> DataFrame:
    """(conv_id, seq, words): digests end to end."""
    hexed = F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
    return seqs.select("conv_id", F.unhex(hexed).alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))


# ---------------------------------------------------------------- a block


def common_turns(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many turns a[i] and b[i] have in common at their beginnings."""
    out = np.zeros(len(a), np.int64)
    n = np.array([min(len(x), len(y)) // WIDTH for x, y in zip(a, b, strict=True)], np.int64)
    if not n.sum():
        return out
    take = lambda rows: np.frombuffer(b"".join(x[: k * WIDTH] for x, k in zip(rows, n.tolist(), strict=True)), np.uint64).reshape(-1, 2)
    same = (take(a) == take(b)).all(1)
    at = np.where(same, np.iinfo(np.int64).max, C.within(n))
    live = np.flatnonzero(n)
    out[live] = np.minimum(np.minimum.reduceat(at, (np.cumsum(n) - n)[live]), n[live])
    return out


class Minima:
    """Sparse table: minima over all runs of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > (step := 1 << (len(self.levels) - 1)):
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of values[lo:hi], hi > lo."""
        k = np.frexp(hi - lo)[1] - 1
        out = np.zeros(len(lo), self.levels[0].dtype)
        for level in np.unique(k):
            m = k == level
            out[m] = np.minimum(self.levels[level][lo[m]], self.levels[level][hi[m] - (1 << level)])
        return out

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place after `at` whose value is below `least`, or the end."""
        at = at + 1
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            ok = np.flatnonzero(at < len(level))
            ok = ok[level[at[ok]] >= least[ok]]
            at[ok] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place up to `at` whose value is below `least`, or 0."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            lo = at - (1 << k) + 1
            ok = np.flatnonzero(lo > 0)
            ok = ok[self.levels[k][lo[ok]] >= least[ok]]
            at[ok] -= 1 << k
        return at


def ids_digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def block_nodes(block: int, ids: np.ndarray, seqs: list[bytes], words: list[list[int]], before: bytes | None, after: bytes | None) -> pa.Table:
    """Nodes and parts of nodes of the sorted rows (seqs, then ids); before and after are the neighbours' sequences."""
    n = len(seqs)
    lens = np.array([len(x) // WIDTH for x in seqs], np.int64)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = common_turns(seqs[:-1], seqs[1:])
    lcp[0] = -1 if before is None else common_turns([before], seqs[:1])[0]
    reach = -1 if after is None else int(common_turns(seqs[-1:], [after])[0])
    table, least_id = Minima(lcp), Minima(ids)

    base = lcp + 1
    base[0] = 0  # in the first row also the nodes that come over from before
    count = lens - base + 1
    row = np.repeat(np.arange(n), count)
    depth = C.within(count) + base[row]
    at_row = np.r_[0, np.cumsum(count)]  # the first node of each row; nodes are in preorder
    begins = depth > lcp[row]
    lo, hi = table.left(row, depth), table.right(row, depth)
    up = np.maximum(depth - 1, 0)
    above = table.left(row, up)
    parent = np.where(depth > 0, at_row[above] + up - base[above], -1)
    partial = ~begins | ((hi == n) & (depth <= reach))

    flat = np.r_[0, np.array([w for x in words for w in x], np.int64)]
    starts = np.cumsum(lens) - lens
    w = np.where(depth > 0, flat[np.where(depth > 0, starts[row] + depth, 0)], 0)
    saved = np.r_[0, np.cumsum((hi - lo) * w - begins * w)]
    saved = saved[at_row[hi]] - saved[:-1]
    children = np.bincount(parent[begins & (depth > 0)], minlength=len(row))
    new = lcp < lens
    before_len = np.r_[-2 if before is None else len(before) // WIDTH, lens[:-1]]
    extends = new & (lcp == before_len)
    sum_new, sum_ext = np.r_[0, np.cumsum(new)], np.r_[0, np.cumsum(extends)]
    leaves = sum_new[hi] - sum_new[lo] - (sum_ext[hi] - sum_ext[lo + 1]) - (~begins & extends[lo])

    # rows that end at a node come first among its members
    stop = np.r_[np.flatnonzero(new), n]
    stop = stop[np.searchsorted(stop, np.arange(n), side="right")]  # where a row's run of equal rows ends
    ends = np.flatnonzero(lens[lo] == depth)
    over = np.zeros(len(row), bool)
    over[ends] = ((lo[ends] == 0) & ~new[0]) | ((stop[lo[ends]] == n) & (after is not None) & (reach == depth[ends]) & (len(after or b"") // WIDTH == depth[ends]))
    digest: list = [NONE] * len(row)
    for c in ends.tolist():
        digest[c] = None if over[c] else ids_digest(ids[lo[c] : stop[lo[c]]])
    ended = np.zeros(len(row), bool)
    ended[ends] = True

    smallest = least_id.least(lo, hi)
    keys: list = [None] * len(row)
    for c in np.flatnonzero(partial).tolist():
        keys[c] = hashlib.md5(seqs[row[c]][: depth[c] * WIDTH]).digest()
    open_parent = (parent >= 0) & partial[parent]
    known = (parent >= 0) & ~open_parent
    some = lambda v, mask: pa.array(v, pa.int64(), mask=~mask)
    cols = {
        "kind": pa.array(np.where(partial, "part", "node").tolist(), pa.string()),
        "block": pa.array(np.full(len(row), block), pa.int32()),
        "key": pa.array(keys, pa.binary()),
        "parent_key": pa.array([keys[p] if o else None for p, o in zip(parent.tolist(), open_parent.tolist(), strict=True)], pa.binary()),
        "conv_id": pa.array(smallest, pa.int64()),
        "depth": pa.array(depth, pa.int64()),
        "parent_conv_id": some(smallest[parent], known),
        "n_convs": pa.array(hi - lo, pa.int64()),
        "n_children": pa.array(children, pa.int64()),
        "n_leaves": pa.array(leaves, pa.int64()),
        "saved_tokens": pa.array(saved, pa.int64()),
        "ends_sha256": pa.array([d if e or not p else None for d, e, p in zip(digest, ended.tolist(), partial.tolist(), strict=True)], pa.string()),
    }
    out = [pa.table(cols)]
    for c in np.flatnonzero(over).tolist():
        own = ids[lo[c] : stop[lo[c]]]
        out.append(pa.table({"kind": ["id"] * len(own), "block": pa.array([block] * len(own), pa.int32()), "key": pa.array([keys[c]] * len(own), pa.binary()), "conv_id": pa.array(own, pa.int64())}))
    return pa.concat_tables(out, promote_options="default")


def _block(key, rows: pa.Table) -> pa.Table:
    at, ids, seqs, words = rows["at"].to_pylist(), rows["conv_id"].to_pylist(), rows["seq"].to_pylist(), rows["words"].to_pylist()
    order = sorted((i for i in range(len(at)) if at[i] == 0), key=lambda i: (seqs[i], ids[i]))
    beside = {at[i]: seqs[i] for i in range(len(at)) if at[i]}
    return block_nodes(key[0].as_py(), np.array([ids[i] for i in order], np.int64), [seqs[i] for i in order], [words[i] for i in order], beside.get(-1), beside.get(1))


def _chain(batches):
    """SHA-256 over ids, comma-joined, of rows sorted by key and id; memory does not grow with a key's rows."""
    last, chain = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([chain.hexdigest()])], ["key", "chained"])
    for batch in batches:
        keys, ids = batch["key"].dictionary_encode(), batch["conv_id"].to_numpy()
        codes = keys.indices.to_numpy()
        cuts = np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes)] if len(codes) else np.zeros(1, int)
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            key = keys.dictionary[int(codes[a])].as_py()
            text = ",".join(map(str, ids[a:z].tolist())).encode()
            if key != last:
                if chain is not None:
                    yield out()
                last, chain = key, hashlib.sha256(text)
            else:
                chain.update(b"," + text)
    if chain is not None:
        yield out()


# ---------------------------------------------------------------- the whole table


def prefix_nodes(seqs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The nodes of sequences (conv_id, seq, words)."""
    spark = seqs.sparkSession
    with C.Scratch() as scratch:
        seqs = C.written(seqs, "sequences")
        blocks = C.parts_for(spark, seqs, "seq", block_bytes)
        ordered = seqs.repartitionByRange(blocks, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").withColumn("block", F.spark_partition_id())
        ordered = C.written(ordered, "ordered")
        edges = C.written(ordered.groupBy("block").agg(F.min(F.struct("seq", "conv_id"))["seq"].alias("first"), F.max(F.struct("seq", "conv_id"))["seq"].alias("last")), "edges")
        own = sorted(r["block"] for r in edges.select("block").collect())  # one number for each block
        beside = spark.createDataFrame(list(zip(own, [None, *own], [*own[1:], None])), "block int, left int, right int")
        beside = edges.join(F.broadcast(beside), "block")
        empty = (F.lit(None).cast("long").alias("conv_id"), F.array().cast("array<bigint>").alias("words"))
        halo = beside.select(F.col("right").alias("block"), F.lit(-1).alias("at"), F.col("last").alias("seq"), *empty).unionByName(beside.select(F.col("left").alias("block"), F.lit(1).alias("at"), F.col("first").alias("seq"), *empty))
        rows = ordered.select("block", F.lit(0).alias("at"), "conv_id", "seq", "words").unionByName(halo.filter("block is not null"))
        found = C.written(rows.groupBy("block").applyInArrow(C.tidy_groups(_block), ROWS), "found")
        return scratch.keep(C.written(_together(found), "nodes"))


def _together(found: DataFrame) -> DataFrame:
    """Whole nodes from nodes and parts."""
    parts, nodes = found.filter("kind = 'part'"), found.filter("kind = 'node'")
    ids = found.filter("kind = 'id'").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    chained = ids.mapInArrow(_chain, "key binary, chained string")
    merged = parts.groupBy("key", "depth").agg(F.first("parent_key", True).alias("parent_key"), F.min("conv_id").alias("conv_id"), *[F.sum(x).alias(x) for x in FIGURES], F.max("ends_sha256").alias("ends_sha256"))
    merged = merged.join(chained, "key", "left").withColumn("ends_sha256", F.coalesce("chained", "ends_sha256", F.lit(NONE)))
    named = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    merged = merged.join(named, "parent_key", "left").withColumn("parent_conv_id", F.col("above"))
    # nodes below a part: the parent's smallest member comes back by block, so that no parent is a hot key
    above = parts.select("block", F.col("key").alias("parent_key")).join(named, "parent_key")
    below = nodes.filter("parent_key is not null").join(above, ["block", "parent_key"]).withColumn("parent_conv_id", F.col("above"))
    names = ("conv_id", "depth", "parent_conv_id", *FIGURES, "ends_sha256")
    return nodes.filter("parent_key is null").select(*names).unionByName(below.select(*names)).unionByName(merged.select(*names))


def prefix_trie(conversations: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The nodes of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return prefix_nodes(packed(rebuilt(sequences(conversations))), block_bytes)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(C.table(spark, sf_dir, "conversations"))


ORACLE_SQL = {
    "op12_prefix_trie": r"""
with recursive table8(i, c, step) as (
  select i::bigint, i::bigint, 0 from range(256) t(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from table8 where step < 8),
tbl as (select list(c order by i) tab from table8 where step = 8),
t as (
  select conv_id, turn, coalesce(role, '') || chr(1) || coalesce(text, '') rt, md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) dg,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) w from conversations where conv_id is not null),
o as (select conv_id, list({'dg': dg, 'w': w} order by turn nulls first, dg) turns from t group by conv_id),
h as (
  select conv_id, turns, xor(list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(conv_id::varchar, '')]), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 4 h from o, tbl),
r as (select h.conv_id, list_concat(coalesce(o.turns, [])[1 : h.h], h.turns[h.h + 1 :]) turns from h left join o on o.conv_id = h.conv_id - h.conv_id % 20),
s as (select conv_id, turns, len(turns) n, array_to_string([x.dg for x in turns], '') seq from r),
m as (select conv_id, n, d, seq[1 : 32 * d] key, case when d > 0 then turns[d].w else 0 end w from s, lateral (select unnest(range(0, n + 1)) d)),
nodes as (
  select key, d, min(conv_id) conv_id, count(*) n_convs, any_value(w) w, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) ends_sha256 from m group by key, d),
kids as (select key[1 : 32 * (d - 1)] key, d - 1 d, count(*) n_children from nodes where d > 0 group by all),
full_nodes as (select nodes.*, coalesce(n_children, 0) n_children from nodes left join kids using (key, d)),
below as (
  select key[1 : 32 * a] key, a d, sum((n_convs - 1) * w)::bigint saved_tokens, count(*) filter (n_children = 0) n_leaves
  from full_nodes, lateral (select unnest(range(0, d + 1)) a) group by all)
select n.conv_id, n.d::bigint depth, p.conv_id parent_conv_id, n.n_convs, n.n_children, below.n_leaves, below.saved_tokens, n.ends_sha256
from full_nodes n join below using (key, d) left join nodes p on p.d = n.d - 1 and p.key = n.key[1 : 32 * (n.d - 1)]
"""
}
