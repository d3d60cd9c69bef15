"""Mixing sources to target weights by temperature.

Source weights are token shares raised to an exponent and normalised. The exponent (1 keeps the shares, 0
makes sources equal) is bisected: to the smallest value at which no source is repeated more than
`max_repeat` times while the largest is used once, or to the value whose weights have a target entropy.
The weights are then realised: documents form blocks of about BLOCK_WORDS words by a hash within their source; each pass
over a source is a permutation of its blocks by another hash, and the last pass stops where the source's
word budget is reached. The block that crosses the budget is taken in part: its documents follow in the order of a
third hash up to the first that crosses the budget, so a budget is met to within that document.

No pass over a source gathers it: blocks are summed by source and bucket of their permuted place, whole
buckets below the budget are taken, and only the bucket that crosses it is ordered block by block; the documents
of the crossing block are split likewise. The
bisection reads a table of one row a source, several steps of the exponent in one pass.

Defined results: a null source is a source of its own (''); tokens are words [^\\x20\\x09-\\x0D]+; documents without
words ride along with their block. Equal rows share block and fate. With no documents the result is empty. Input
columns are returned unchanged, but those named like one of the five output columns are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

MAX_REPEAT, BLOCK_WORDS, BUCKETS, SEED = 2.0, 50_000, 256, 17
STEPS, AT_ONCE = 48, 6
MADE = ("mix_source", "mix_words", "mix_block", "mix_epoch", "mix_place")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def totals(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, words, docs) of each source, written."""
    return _totals(docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"), words(F.col(text_col)).alias("mix_words")))


def _totals(thin: DataFrame) -> DataFrame:
    return C.written(thin.groupBy(F.col("mix_source").alias("source")).agg(F.sum("mix_words").alias("words"), F.count("*").alias("docs")), "totals")


def exponent(stats: DataFrame, max_repeat: float | None = MAX_REPEAT, entropy: float | None = None, steps: int = STEPS) -> float:
    """The exponent in [0, 1] by bisection. Each pass over the stats answers AT_ONCE steps: it evaluates the
    2^AT_ONCE - 1 midpoints that these steps may ask for."""
    live = stats.filter("words > 0")
    total = live.agg(F.sum("words")).first()[0]
    if not total:
        return 1.0
    low, high = 0.0, 1.0
    ln = F.log(F.col("words") / F.lit(float(total)))
    for _ in range(0, steps, AT_ONCE):
        n = 1 << AT_ONCE
        grid = [low + (high - low) * i / n for i in range(1, n)]
        at = live.select(ln.alias("ln"), F.explode(F.array(*map(F.lit, grid))).alias("a"))
        s = at.groupBy("a").agg(F.sum(F.exp(F.col("a") * F.col("ln"))).alias("z"), F.sum(F.exp(F.col("a") * F.col("ln")) * F.col("a") * F.col("ln")).alias("t"), F.min("ln").alias("least"), F.max("ln").alias("most"))
        # a larger exponent repeats less and has less entropy
        if entropy is not None:
            fine = F.log("z") - F.col("t") / F.col("z") <= F.lit(entropy)
        else:
            fine = F.exp((F.lit(1.0) - F.col("a")) * (F.col("most") - F.col("least"))) <= F.lit(float(max_repeat))
        ok = {r["a"]: r["ok"] for r in s.select("a", fine.alias("ok")).collect()}
        lo, hi = 0, n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ok[grid[mid - 1]] else (mid, hi)
        low, high = low + (high - low) * lo / n, low + (high - low) * hi / n
    return high


def weigh(stats: DataFrame, a: float) -> DataFrame:
    """stats with weight, target (the words asked of the source) and repeats (target / words). The source of the
    greatest words-to-weight ratio is used once, so no document is lost."""
    live = stats.withColumn("p", F.when(F.col("words") > 0, F.pow(F.col("words").cast("double"), F.lit(a))).otherwise(0.0))
    z, scale = live.agg(F.sum("p"), F.max(F.when(F.col("p") > 0, F.col("words") / F.col("p")))).first()
    target = F.greatest(F.col("words"), F.round(F.col("p") * F.lit(scale or 0.0)).cast("long"))
    return live.select("source", "words", "docs", (F.col("p") / F.lit(z or 1.0)).alias("weight"), target.alias("target"), F.coalesce(target / F.nullif(F.col("words"), F.lit(0)), F.lit(1.0)).alias("repeats"), F.greatest(F.lit(1), F.ceil(F.col("words") / F.lit(BLOCK_WORDS))).cast("long").alias("blocks"))


def place(*parts) -> Column:
    """A place from 0 to 2^32 - 1 by hash, by the same rule in any SQL: the first eight hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[F.lit(p) if isinstance(p, (int, str)) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def split_at(units: DataFrame, order: list[str], limit: str) -> tuple[DataFrame, DataFrame]:
    """units (mix_source, w, and the columns of order, of which the first is a place) of each source in that order: those
    within the limit, and the one that crosses it, with left, the words of the limit before it. Units share no order."""
    units = units.withColumn("bucket", F.floor(F.col(order[0]) * BUCKETS / F.lit(1 << 32)).cast("int"))
    hist = units.groupBy("mix_source", "bucket").agg(F.sum("w").alias("bw"))  # at most BUCKETS rows a source
    w = Window.partitionBy("mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = hist.withColumn("before", F.coalesce(F.sum("bw").over(w), F.lit(0)))
    placed = units.join(before, ["mix_source", "bucket"])
    inner = Window.partitionBy("mix_source", "bucket").orderBy(*order)
    edge = placed.filter(f"before < {limit} and before + bw > {limit}").withColumn("sofar", F.col("before") + F.sum("w").over(inner))
    within = placed.filter(f"before + bw <= {limit}").select(*units.columns).unionByName(edge.filter(f"sofar <= {limit}").select(*units.columns))
    crossing = edge.filter(f"sofar > {limit} and sofar - w < {limit}").select(*units.columns, F.expr(f"{limit} - (sofar - w)").alias("left"))
    return within, crossing


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", max_repeat: float = MAX_REPEAT, entropy: float | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as the mix asks, with mix_source, mix_words, mix_block, mix_epoch and mix_place
    (the block's place in that pass)."""
    def placed(*more) -> DataFrame:
        """Documents with their source, and their places: the hash that deals them to a block, and that within it."""
        ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
        text = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("null"))
        return docs.select(*more, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"), words(F.col(text_col)).alias("mix_words"), place(seed, "block", ident).alias("mix_at"), place(seed, "doc", ident, text).alias("mix_doc"))

    # the texts are read twice: for this thin table, from which all is planned, and for the rows that come out
    thin = C.written(placed(), "thin")
    stats = _totals(thin)
    plan = C.written(weigh(stats, exponent(stats, max_repeat, entropy)), "plan")
    # The plan has one row a source: a number that the sources bound, not the rows; it is joined, not broadcast by hint.
    p = plan.select(F.col("source").alias("mix_source"), F.col("blocks").alias("mix_blocks"), "target", F.col("words").alias("total"))
    blocks, block = p.select("mix_source", "mix_blocks"), F.pmod("mix_at", "mix_blocks").alias("mix_block")
    dealt = thin.join(blocks, "mix_source").select("mix_source", "mix_words", block, "mix_doc")
    sums = dealt.groupBy("mix_source", "mix_block").agg(F.sum("mix_words").alias("w"))
    # passes: whole ones, then one that is cut where the budget ends
    whole = F.when(F.col("total") > 0, F.floor(F.col("target") / F.nullif(F.col("total"), F.lit(0)))).otherwise(1).cast("int")
    passes = p.select("mix_source", whole.alias("whole"), F.when(F.col("total") > 0, F.col("target") - whole * F.col("total")).otherwise(0).alias("rest"))
    at = sums.join(passes, "mix_source")
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("mix_epoch"))
    at = at.withColumn("mix_place", place(seed, "pass", F.col("mix_source"), F.col("mix_epoch"), F.col("mix_block")))
    cut = at.filter("mix_epoch = whole and rest > 0")
    key = ["mix_source", "mix_block", "mix_epoch", "mix_place"]
    within, crossing = split_at(cut, ["mix_place", "mix_block"], "rest")
    # one row a source, and the place in its crossing block of the document that crosses the budget
    crossing = C.written(crossing.select(*key, "left"), "crossing")
    parts = dealt.filter("mix_words > 0").join(crossing, ["mix_source", "mix_block"]).groupBy("mix_source", "mix_doc", "left").agg(F.sum("mix_words").alias("w"))
    stops = split_at(parts, ["mix_doc"], "left")[1].select("mix_source", F.col("mix_doc").alias("mix_stop"))
    chosen = at.filter("mix_epoch < whole").select(*key).unionByName(within.select(*key)).withColumn("mix_stop", F.lit(None).cast("long"))
    chosen = chosen.unionByName(crossing.join(stops, "mix_source").select(*key, "mix_stop"))
    # one row a block with its passes, so that documents are joined once and then repeated
    by_block = chosen.groupBy("mix_source", "mix_block").agg(F.array_sort(F.collect_list(F.struct("mix_epoch", "mix_place", "mix_stop"))).alias("mix_passes"))
    # the input's columns travel under names of their own, each pruned where nothing asks for it
    taken = {c: f"mix_own_{i}" for i, c in enumerate(docs.columns) if c not in MADE}
    own = [F.col(f"`{c}`").alias(name) for c, name in taken.items()]
    out = placed(*own).join(blocks, "mix_source").select(*taken.values(), "mix_source", "mix_words", block, "mix_doc")
    out = out.join(by_block, ["mix_source", "mix_block"]).select(*taken.values(), "mix_source", "mix_words", "mix_block", "mix_doc", F.explode("mix_passes").alias("mix_e"))
    out = out.filter("mix_e.mix_stop is null or mix_doc < mix_e.mix_stop")
    return out.select(*[F.col(name).alias(c) for c, name in taken.items()], "mix_source", "mix_words", "mix_block", "mix_e.mix_epoch", "mix_e.mix_place")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", F.col("mix_source").alias("source"), F.col("mix_words").alias("n_words"), F.col("mix_block").alias("block"), F.col("mix_epoch").alias("epoch"), F.col("mix_place").alias("place"))


ORACLE_SQL = {
    "op5_source_mixing": rf"""with recursive
d as (select doc_id, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as w, ('0x' || substr(md5('{SEED}/block/' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint as bp,
  ('0x' || substr(md5('{SEED}/doc/' || coalesce(doc_id::varchar, 'null') || '/' || coalesce(md5(text), 'null')), 1, 8))::bigint as dp from documents),
st as (select source, sum(w)::bigint as words from d group by 1),
x as (select max(ln(words / total)) - min(ln(words / total)) as spread from st, (select sum(words)::double as total from st) where words > 0),
bis(i, lo, hi) as (select 0, 0.0::double, 1.0::double union all select i + 1, case when ok then lo else mid end, case when ok then mid else hi end from (select i, lo, hi, (lo + hi) / 2 as mid, exp((1 - (lo + hi) / 2) * spread) <= {MAX_REPEAT} as ok from bis, x) where i < {STEPS}),
p as (select source, words, pow(words::double, (select hi from bis where i = {STEPS})) as p from st where words > 0),
t as (select source, words, greatest(words, round(p * (select max(words / p) from p))::bigint) as target from p union all select source, 0, 0 from st where words = 0),
plan as (select source, words, case when words > 0 then target // words else 1 end as whole, case when words > 0 then target % words else 0 end as rest, greatest(1, ceil(words / {float(BLOCK_WORDS)}))::bigint as blocks from t),
dealt as (select d.*, bp % blocks as block from d join plan using (source)),
b as (select source, block, sum(w)::bigint as bw from dealt group by 1, 2),
passes as (select *, ('0x' || substr(md5('{SEED}/pass/' || source || '/' || epoch || '/' || block), 1, 8))::bigint as place from (select b.*, whole, rest, unnest(range(0, whole + 1)) as epoch from b join plan using (source))),
cut as (select *, sum(bw) over (partition by source order by place, block) as sofar from passes where epoch = whole and rest > 0),
crossing as (select source, block, epoch, place, rest - (sofar - bw) as left_words from cut where sofar > rest and sofar - bw < rest),
stops as (select source, min(dp) as stop from (select source, dp, left_words, sum(w) over (partition by source order by dp) as sofar from (select source, dp, left_words, sum(w) as w from dealt join crossing using (source, block) group by 1, 2, 3)) where sofar > left_words group by 1),
chosen as (select source, block, epoch, place, null::bigint as stop from passes where epoch < whole union all select source, block, epoch, place, null from cut where sofar <= rest union all select source, block, epoch, place, stop from crossing join stops using (source))
select doc_id, source, w as n_words, block, epoch::int as epoch, place from dealt join chosen using (source, block) where stop is null or dp < stop"""
}
