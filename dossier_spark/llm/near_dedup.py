"""Near-duplicate classes by a chosen-path set similarity join.

A document is its set of 5-word shingles, each a 128-bit hash. Equal sets collapse to one representative first.
Each representative carries 128 minwise tokens. Trees are independent: in tree r all documents start at the
root and branch by token r; a node of more than NODE members branches again, each member choosing the
node's BRANCH tokens, until nodes are small. Small nodes compare all their members; pairs whose tokens
agree on enough places are then confirmed on the full shingle sets, taken again from the whole texts.

A pair at similarity 0.75 stays together at a level with probability 1 - 0.25^2 (0.75 at the first), so
one tree finds it with probability of 0.58 or more at depth 5 and TREES = 10 trees miss it with under
0.0002; most nodes end at depth 1, where all ten miss it with 0.000001.

The work goes in two rounds. In the first each member of a first-level node, or of a part of PART members of
a large one, proposes its best few pairs; confirmed ones merge into classes. Only then do large nodes branch,
and not those where few members are outside one main class (VISITS comparisons at most): groups of near
copies are settled by a number of pairs in proportion to their size. In the second round members outside a
node's main class meet all its parts, in blocks of PART, so a task holds two blocks however large the node is;
members that may be linked with another class bring their texts, and each block tests all such pairs exactly,
passing over classes it has already joined. No link that joins two classes is lost to a bound.

Defined results: no words or null text means an empty set, linked with nothing; component_id is the
smallest non-null doc_id reachable (null if all are null); rows with equal sets share a class; repeated
rows are copies. kept compares doc_id with component_id, nulls as equal. Only the id and the text are read:
other columns, whatever their names, are left out of near_duplicates and returned whole by drop_duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE, NUM, DEN = 5, 75, 100
TOKENS, TREES, BRANCH, DEPTH = 128, 10, 2, 5
NODE, PART, VISITS = 1024, 1024, 1 << 22
SLACK = 3.5
FIRST_BOUND = 2
BROADCAST_KEYS = 1 << 19  # keys of three longs
CONFIRM_BYTES = 8 << 20


Shingles = tuple[np.ndarray, np.ndarray]  # two independent hashes of each shingle, in their order


def distinct(x: np.ndarray, y: np.ndarray) -> Shingles:
    """The distinct pairs (x, y), in order."""
    order = np.argsort(x)
    a, b = x[order], y[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # equal under one hash only: order by both
        order = np.lexsort((y, x))
        a, b = x[order], y[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    keep = np.r_[True, ~same] if len(a) else np.zeros(0, bool)
    return a[keep], b[keep]


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> list[Shingles]:
    """The set of shingles of each text."""
    b = C.LOWER_AZ[buf]
    s, e, n = C.word_spans(b, offs)
    if not len(s):
        return [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))] * len(n)
    base = np.cumsum(n) - n
    length = np.minimum(n, size)
    starts = np.maximum(n - size, 0) + (n > 0)
    at, long = np.repeat(base, starts) + C.within(starts), np.repeat(length, starts)
    x, y = (C.short_runs(C.word_hashes(b, s, e, seed), at, long, size) for seed in (3, 4))
    cut = np.r_[0, np.cumsum(starts)]
    return [distinct(x[a:z], y[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]


def minwise(sets: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minwise tokens: the least value of each of the random maps over the set."""
    x = (sets >> np.uint64(32)).astype(np.uint32) ^ (sets & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[None, i : i + 1024] * mult[:, None] + add[:, None]).min(axis=1), out=out)
    return out


def maps(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (C.seeded(n, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (C.seeded(n, 12) >> np.uint64(32)).astype(np.uint32)


def _sign(tokens: int, trees: int, size: int) -> Callable:
    mult, add = maps(tokens)

    def run(batches):
        for batch in batches:
            buf, offs = C.text_buffers(batch["text"])
            n, digest, sig, nodes = [], [], [], []
            for lo, hi in C.doc_slices(offs):
                for x, y in shingle_sets(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], size):
                    n.append(len(x))
                    if not len(x):
                        digest.append(None), sig.append(None), nodes.append(None)
                        continue
                    m = minwise(x, mult, add)
                    digest.append(hashlib.blake2b(x.tobytes() + y.tobytes(), digest_size=16).digest())
                    sig.append(m.tobytes())
                    nodes.append(child(np.zeros(trees, np.uint64), np.arange(trees), m[:trees]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["ka"], batch["kb"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                ["doc_id", "ka", "kb", "n_shingles", "digest", "sig", "nodes"],
            )

    return run


def child(node: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return C.mix(C.mix(node + (coordinate.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) + token.astype(np.uint64))


def _branch(tokens: int, branch: int) -> Callable:
    """Each member of a large node goes to one child for each of the node's chosen tokens."""

    def run(batches):
        for batch in batches:
            node = np.asarray(batch["node"]).astype(np.int64).view(np.uint64)
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint32).reshape(len(node), tokens) if len(node) else np.zeros((0, tokens), np.uint32)
            for i in range(branch):
                c = (C.mix(node + np.uint64(i + 1)) % np.uint64(tokens)).astype(np.int64)
                out = child(node, c, sig[np.arange(len(node)), c])
                yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), batch["k"], batch["sig"]], ["node", "k", "sig"])

    return run


CONTESTED = ["node", "part", "block", "guest", "k", "sig", "c"]


def _members(members: pa.Table, tokens: int):
    """Distinct members of a block by key and role: order, keys, classes, tokens, which are guests."""
    k, guest = members["k"].to_numpy(), members["guest"].to_numpy(zero_copy_only=False)
    order = np.lexsort((guest, k))
    order = order[np.r_[True, (k[order][1:] != k[order][:-1]) | (guest[order][1:] != guest[order][:-1])]] if len(k) else order
    blobs = members["sig"].to_pylist()
    return order, k[order], members["c"].to_numpy()[order], np.frombuffer(b"".join(blobs[i] for i in order), np.uint32).reshape(len(order), tokens), guest[order]


def _agreements(c: np.ndarray, sig: np.ndarray, guest: np.ndarray, floor: int):
    """Some rows at a time: rows, columns, agreements, and where classes differ and enough places agree. Guests meet those
    at home in the block; without guests all meet all."""
    rows, cols = (np.flatnonzero(guest), np.flatnonzero(~guest)) if guest.any() else (np.arange(len(c)), np.arange(len(c)))
    other, tokens = sig[cols], sig.shape[1]
    step = max(1, (1 << 22) // max(1, len(cols) * tokens))
    for lo in range(0, len(rows), step):
        at = rows[lo : lo + step]
        agree = np.zeros((len(at), len(cols)), np.uint8)
        for t in range(0, tokens, 32):
            agree += (sig[at, None, t : t + 32] == other[None, :, t : t + 32]).sum(2, dtype=np.uint8)
        yield at, cols, agree, (agree >= floor) & (c[at, None] != c[None, cols])


def _propose(tokens: int, floor: int, bound: int) -> Callable:
    """The best `bound` pairs of each member of a node part whose tokens agree on `floor` places or more."""

    def run(members: pa.Table) -> pa.Table:
        _, k, c, sig, guest = _members(members, tokens)
        a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, cols, agree, ok in _agreements(c, sig, guest, floor):
            if (ok.sum(1) > bound).any():
                score = np.where(ok, agree, 0).astype(np.int16)
                best = np.argpartition(-score, min(bound, len(k) - 1), axis=1)[:, :bound]
                few = np.zeros_like(ok)
                np.put_along_axis(few, best, True, axis=1)
                ok &= few
            i, j = np.nonzero(ok)
            a_out.append(np.minimum(k[at[i]], k[cols[j]])), b_out.append(np.maximum(k[at[i]], k[cols[j]]))
        a, b = np.concatenate(a_out), np.concatenate(b_out)
        if len(a):
            a, b = np.unique(np.stack([a, b], 1), axis=0).T
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _contested(tokens: int, floor: int) -> Callable:
    """Members of a block that may be linked with a member of another class."""

    def run(members: pa.Table) -> pa.Table:
        order, _, c, sig, guest = _members(members, tokens)
        hit = np.zeros(len(order), bool)
        if len(c) and (c != c[0]).any():
            for at, cols, _, ok in _agreements(c, sig, guest, floor):
                hit[at] |= ok.any(1)
                hit[cols] |= ok.any(0)
        return members.take(pa.array(order[hit], pa.int64())).select(CONTESTED)

    return run


class SetsOf:
    """The shingle sets of texts, made when asked for; the latest ones are held up to `limit` bytes."""

    def __init__(self, texts, size: int, limit: int = 64 << 20):
        self.texts, self.size, self.limit, self.held, self.bytes = texts, size, limit, {}, 0

    def __getitem__(self, i: int) -> Shingles:
        if (got := self.held.get(i)) is None:
            buf = np.frombuffer((self.texts[i].as_py() or "").encode(), np.uint8)
            got = self.held[i] = shingle_sets(buf, np.array([0, len(buf)]), self.size)[0]
            self.bytes += 16 * len(got[0])
            while self.bytes > self.limit and len(self.held) > 2:
                self.bytes -= 16 * len(self.held.pop(next(iter(self.held)))[0])
        return got


def _resolve(tokens: int, floor: int, num: int, den: int, size: int) -> Callable:
    """Exact links between the contested members of a block; pairs of classes united here are passed over."""

    def run(members: pa.Table) -> pa.Table:
        order, k, c, sig, guest = _members(members, tokens)
        texts, count = members["text"].combine_chunks(), members["n"].to_numpy()[order]
        sets = SetsOf(texts, size)
        pairs = []
        for at, cols, agree, ok in _agreements(c, sig, guest, floor):
            if not guest.any():
                ok &= at[:, None] < cols[None, :]
            x, y = count[at, None], count[None, cols]
            ok &= den * np.minimum(x, y) >= num * np.maximum(x, y)
            i, j = np.nonzero(ok)
            pairs.append(np.stack([agree[i, j].astype(np.int64), at[i], cols[j]], 1))
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
        pairs = pairs[np.argsort(-pairs[:, 0], kind="stable")]
        up = {x: x for x in c.tolist()}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        cl, links = c.tolist(), []
        for _, i, j in pairs.tolist():
            x, y = root(cl[i]), root(cl[j])
            if x != y and similar(sets[int(order[i])], sets[int(order[j])], num, den):
                up[x] = y
                links.append((k[i], k[j]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def similar(x: Shingles, y: Shingles, num: int, den: int) -> bool:
    """intersection * den >= union * num, for sets in order."""
    short, long = (x, y) if len(x[0]) < len(y[0]) else (y, x)
    if not len(short[0]):
        return False
    at = np.minimum(np.searchsorted(long[0], short[0]), len(long[0]) - 1)
    both = int(((long[0][at] == short[0]) & (long[1][at] == short[1])).sum())
    return den * both >= num * (len(x[0]) + len(y[0]) - both)


def _confirm(num: int, den: int, size: int) -> Callable:
    """Pairs (a, b, ta, tb) that are linked. The sets of a run of texts are made together, each text's once."""

    def run(batches):
        for batch in batches:
            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            ok = np.zeros(len(a), bool)
            weight = np.cumsum(np.asarray(pc.binary_length(batch["ta"])).astype(np.int64) + np.asarray(pc.binary_length(batch["tb"])))
            lo = 0
            while lo < len(a):
                hi = max(lo + 1, int(np.searchsorted(weight, (weight[lo - 1] if lo else 0) + CONFIRM_BYTES, side="right")))
                keys, first = np.unique(np.concatenate([a[lo:hi], b[lo:hi]]), return_index=True)
                texts = pa.concat_arrays([batch["ta"].slice(lo, hi - lo), batch["tb"].slice(lo, hi - lo)]).take(pa.array(first))
                buf, offs = C.text_buffers(texts)
                sets = [x for p, q in C.doc_slices(offs) for x in shingle_sets(buf[offs[p] : offs[q]], offs[p : q + 1] - offs[p], size)]
                ia, ib = np.searchsorted(keys, a[lo:hi]), np.searchsorted(keys, b[lo:hi])
                ok[lo:hi] = [similar(sets[i], sets[j], num, den) for i, j in zip(ia.tolist(), ib.tolist(), strict=True)]
                lo = hi
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(ok)), batch["b"].filter(pa.array(ok))], ["a", "b"])

    return run


def stars(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges (u, v), u > v, with the same components as the edges (a, b), by large-star and small-star rounds; without
    `rounds` until they are stars around each component's smallest key.

    Stars are made by a grouped minimum and a join, not a window, so a hub's edges may be spread over tasks.
    """
    e = C.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state, done = None, 0
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = C.written(small, "edges")
        done += 1
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or done == rounds:
            return e
        state = now


def named(e: DataFrame) -> DataFrame:
    """(k, c) of edges by stars(): each key's least neighbour, itself if it has no smaller one. After all rounds that
    is the smallest key of its component; after fewer, some key of it."""
    return e.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("c"))


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id, kept. Links are intersection * den >= union * num.
    how: the parameters of classes()."""
    rows = classes(df, text_col, id_col, **how)
    first = rows.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("first_id"))
    out = rows.join(first, "c", "left").withColumn("component_id", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("first_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """df with one row of each class: that of the smallest id, nulls last, and of rows with that id one. Rows without
    words are linked with nothing and all stay. All columns are returned, whatever their names."""
    rows = classes(df, text_col, id_col, **how).select("doc_id", "ka", "kb", "c")
    grouped = rows.filter("c is not null").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "ka", "kb")).alias("r"))
    # a row's keys stand for its id and text: those of the chosen rows, and how many rows carry them
    chosen = grouped.select("r.ka", "r.kb").unionByName(rows.filter("c is null").select("ka", "kb").distinct().withColumn("loose", F.lit(True)), allowMissingColumns=True)
    times = rows.groupBy("ka", "kb").agg(F.count("*").alias("n"))
    chosen = C.written(chosen.join(times, ["ka", "kb"]).select(F.col("ka").alias("_ka"), F.col("kb").alias("_kb"), (F.col("loose").isNull() & (F.col("n") > 1)).alias("_again")), "chosen")
    own = {x: f"_own_{i}" for i, x in enumerate(df.columns)}  # names that clash with nothing
    d = df.select(*[F.col(f"`{x}`").alias(y) for x, y in own.items()])
    ka, kb = C.row_keys(own[id_col], own[text_col])
    d = d.select("*", ka, kb)
    both = (F.col("ka") == F.col("_ka")) & (F.col("kb") == F.col("_kb"))
    back = [F.col(y).alias(x) for x, y in own.items()]
    if chosen.filter("_again").limit(1).count() == 0:
        return d.join(chosen, both, "left_semi").select(*back)
    once = d.join(chosen.filter("not _again"), both, "left_semi")
    again = d.join(chosen.filter("_again"), both, "left_semi").dropDuplicates(["ka", "kb"])
    return once.unionByName(again).select(*back)


def classes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", num: int = NUM, den: int = DEN, size: int = SHINGLE, tokens: int = TOKENS, trees: int = TREES, node: int = NODE, part: int = PART, depth: int = DEPTH) -> DataFrame:
    """(doc_id, ka, kb, n_shingles, c) of each row of df: its keys, the size of its set and its class, null for an empty set."""
    ka, kb = C.row_keys(id_col, text_col)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), ka, kb, F.col(text_col).cast("string").alias("text"))
    signed = C.written(docs.mapInArrow(C.tidy(_sign(tokens, trees, size)), "doc_id long, ka long, kb long, n_shingles long, digest binary, sig binary, nodes array<long>"), "signed")
    one = signed.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("ka", "kb")).alias("row"), F.first("n_shingles").alias("n"))
    # numbers once written stay as they are, and no two sets share one
    owner = C.written(one.select("digest", "row.ka", "row.kb", "n", F.monotonically_increasing_id().alias("k")), "owner")
    reps = signed.join(owner, ["digest", "ka", "kb"]).select("k", "sig", "nodes").dropDuplicates(["k"])

    with C.Scratch() as made:  # the many tables on the way go as soon as the classes are named
        comp = made.keep(C.written(named(stars(_links(docs, owner, reps, num, den, size, tokens, node, part, depth))), "classes"))
    # the classes of representatives, then of rows; a representative without a smaller one names its own class
    owned = owner.join(comp, "k", "left").select("digest", F.coalesce("c", "k").alias("c"))
    return signed.select("doc_id", "ka", "kb", "n_shingles", "digest").join(owned, "digest", "left").drop("digest")


def _first_level(reps: DataFrame, part: int, node: int) -> DataFrame:
    """Members of the nodes of two or more at the first level of all trees."""
    keys = reps.select("k", F.explode("nodes").alias("node"))
    counts = keys.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    return C.written(_dealt(keys.join(counts, "node").join(reps.select("k", "sig"), "k"), part), "level")


def _dealt(members: DataFrame, part: int) -> DataFrame:
    """Members with the part of their node they are dealt to."""
    parts = F.ceil(F.col("n") / F.lit(part)).cast("int")
    return members.select("node", "k", "sig", "n", parts.alias("parts"), F.pmod(F.xxhash64("k"), parts).cast("int").alias("part"))


def _grow(members: DataFrame, comp: DataFrame, tokens: int, node: int, part: int, depth: int) -> DataFrame:
    """The leaves: small nodes, nodes with few members outside their main class, and what is left at `depth`."""
    out = members.filter(F.col("n") <= node)
    for level in range(1, depth + 1):
        large = members.filter(F.col("n") > node)
        if large.limit(1).count() == 0:
            break
        if level == depth:
            return C.written(out.unionByName(large), "leaves")
        named = large.select("node", "k", "n").join(comp, "k", "left").select("node", F.coalesce("c", "k").alias("c"), "n")
        mains = named.groupBy("node", "c").agg(F.count("*").alias("m"), F.first("n").alias("n")).groupBy("node").agg((F.first("n") - F.max("m")).alias("outside"), F.first("n").alias("n"))
        mains = C.written(mains, "mains")
        settled = mains.filter(F.col("outside") * F.col("n") <= VISITS).select("node")
        out = out.unionByName(large.join(settled, "node", "left_semi"))
        below = C.written(large.join(settled, "node", "left_anti").select("node", "k", "sig").mapInArrow(C.tidy(_branch(tokens, BRANCH)), "node long, k long, sig binary").dropDuplicates(["node", "k"]), "branch")
        counts = below.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        members = C.written(_dealt(below.join(counts, "node"), part), "level")
        out = out.unionByName(members.filter(F.col("n") <= node))
    return C.written(out, "leaves")


def _blocks(m: DataFrame, part: int) -> DataFrame:
    """Who meets whom in the second round: members (node, part, parts, k, sig, c) in blocks (node, part, block). A node of
    one part is a block of its own, -1. In larger ones those outside the main class are guests, in blocks of about `part`,
    of every part, where they meet those at home; a node all in its main class has nothing left to settle."""
    own = m.filter("parts = 1").select("node", "part", F.lit(-1).alias("block"), F.lit(False).alias("guest"), "k", "sig", "c")
    split = m.filter("parts > 1")
    if split.limit(1).count() == 0:
        return own
    sizes = split.groupBy("node", "c").agg(F.count("*").alias("n"))
    main = sizes.groupBy("node").agg(F.max_by("c", F.struct("n", "c")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"))
    main = C.written(main.filter("outside > 0").select("node", "main", F.ceil(F.col("outside") / F.lit(part)).cast("int").alias("blocks")), "mains")
    both = split.join(main, "node")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = both.select("node", "part", every("blocks").alias("block"), F.lit(False).alias("guest"), "k", "sig", "c")
    guest = both.filter("c <> main").select("node", every("parts").alias("part"), F.pmod(F.xxhash64("k", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("guest"), "k", "sig", "c")
    return own.unionByName(home).unionByName(guest)


def _links(docs: DataFrame, owner: DataFrame, reps: DataFrame, num: int, den: int, size: int, tokens: int, node: int, part: int, depth: int) -> DataFrame:
    """Confirmed links (a, b) that together give the classes of all links."""
    j = num / den
    floor = max(1, int(np.floor(tokens * (j - SLACK * np.sqrt(j * (1 - j) / tokens)))))

    def texts_of(keys: DataFrame) -> DataFrame:
        """The texts of keys. Up to BROADCAST_KEYS of them go to the documents; beyond, both sides are shuffled."""
        keys = C.written(keys.join(owner.select("ka", "kb", "k"), "k"), "keys")
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
        return C.written(docs.select("ka", "kb", "text").join(keys, ["ka", "kb"]).select("k", "text").dropDuplicates(["k"]), "texts")

    # first round: the best few pairs of each member, confirmed
    first = _first_level(reps, part, node)
    proposed = first.select("node", "part", F.lit(-1).alias("block"), F.lit(False).alias("guest"), "k", "sig", F.col("k").alias("c")).groupBy("node", "part").applyInArrow(C.tidy_groups(_propose(tokens, floor, FIRST_BOUND), 1000), "a long, b long")
    pairs = C.written(proposed.distinct(), "pairs")
    full = texts_of(pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct())
    ta, tb = full.select(F.col("k").alias("a"), F.col("text").alias("ta")), full.select(F.col("k").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
    links = C.written(both.mapInArrow(C.tidy(_confirm(num, den, size)), "a long, b long"), "links")
    early = stars(links, rounds=2)
    comp = named(early)

    # second round: what may still join two classes, settled exactly within the leaves
    leaves = _grow(first, comp, tokens, node, part, depth)
    m = leaves.join(comp, "k", "left").select("node", "part", "parts", "k", "sig", F.coalesce("c", "k").alias("c"))
    meeting = _blocks(m, part).groupBy("node", "part", "block")
    contested = C.written(meeting.applyInArrow(C.tidy_groups(_contested(tokens, floor), 1000), "node long, part int, block int, guest boolean, k long, sig binary, c long"), "contested")
    # only members of split or branched nodes can lack their text; mostly there are none
    lacking = C.written(contested.select("k").distinct().join(full.select("k"), "k", "left_anti"), "lacking")
    if lacking.limit(1).count():
        full = full.unionByName(texts_of(lacking))
    held = contested.join(full, "k").join(owner.select("k", "n"), "k")
    found = held.groupBy("node", "part", "block").applyInArrow(C.tidy_groups(_resolve(tokens, floor, num, den, size), 100), "a long, b long")
    return C.written(early.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(found), "links")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
