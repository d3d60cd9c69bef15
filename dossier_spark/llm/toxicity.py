"""Toxicity scores by non-negative positive-unlabelled learning.

Features are the words and word beginnings (3 to 8 letters) that a document holds, each once. A bounded
sample of confirmed toxic documents and of any documents, whose labels are not looked at, is drawn by hash;
Spark counts every feature's documents in both, and of the features that toxic documents hold significantly
more often (LEAST_Z deviations, at least LEAST_PURITY toxic) the TOP are kept. A logistic classifier is fitted
in numpy by the non-negative risk: the class prior times the risk of positives, plus the greater of zero
and the unlabelled risk as negatives less the prior times the positives' risk as negatives. The prior is
the toxic share of the labelled training rows.

Bounds of the sample (parameters): POSITIVES and UNLABELLED rows, equal ones once. Every document is scored whole.

Defined results: a null text scores like an empty one; labels of null count as no label; a document with
several label rows is positive if one says so. Without any positive label every score is next to 0 (below 1e-20). Repeated rows
score equally. Other columns of the input are returned unchanged, but those named like an output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

POSITIVES, UNLABELLED, TOP = 4000, 8000, 1024
LEAST_Z, LEAST_PURITY = 5.5, 0.6
SHORTEST, LONGEST = 3, 8
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
WORD = re.compile(r"[^\W\d_]+")
CACHE = 200_000


def held_out(id_col: str = "doc_id"):
    """crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def features_of(word: str) -> list[str]:
    """A word, marked as whole, and its beginnings."""
    return [word + "$", *(word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in features_of(w)}


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def scorer(self) -> Callable[[str], float]:
        index = {f: i for i, f in enumerate(self.names)}
        known: dict[str, tuple[int, ...]] = {}

        def score(text: str) -> float:
            hit: set[int] = set()
            for w in set(WORD.findall(text.lower())):
                at = known.get(w)
                if at is None:
                    at = tuple(index[f] for f in features_of(w) if f in index)
                    if len(known) >= CACHE:
                        known.clear()
                    known[w] = at
                if at:
                    hit.update(at)
            z = self.bias + float(sum(self.weights[i] for i in sorted(hit)))
            return float(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))

        return score


class Sparse:
    """The entries of a matrix that are not zero: most of a document's features are."""

    def __init__(self, x: np.ndarray):
        self.n, self.width = x.shape
        self.row, self.col = np.nonzero(x)
        self.value = x[self.row, self.col].astype(np.float64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.n)

    def summed(self, s: np.ndarray) -> np.ndarray:
        """The rows added up, each times its s."""
        return np.bincount(self.col, self.value * s[self.row], self.width)


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic weights by the non-negative risk, with Adam on the whole sample. Where the negative part of
    the risk falls below zero, the step is taken against it instead."""
    p, u = Sparse(x[positive]), Sparse(x[~positive])
    w, b = np.zeros(x.shape[1]), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        zp, zu = p.times(w) + b, u.times(w) + b
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -50, 50))), 1 / (1 + np.exp(-np.clip(zu, -50, 50)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gn_w, gn_b = u.summed(su) / u.n - prior * p.summed(sp) / p.n, su.mean() - prior * sp.mean()
        if negative >= 0:
            g = np.r_[-prior * p.summed(1 - sp) / p.n + gn_w, -prior * (1 - sp).mean() + gn_b]
        else:
            g = -np.r_[gn_w, gn_b]
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _count(batches):
    """Documents with each feature, for positives and others, added up within a partition in blocks."""
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def out():
        names = list(counts[True].keys() | counts[False].keys())
        batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[s][f] for f in names], pa.int64()) for s in (True, False))], ["f", "p", "u"])
        counts[True].clear(), counts[False].clear()
        return batch

    for batch in batches:
        for text, positive in zip(batch["text"], batch["positive"], strict=True):
            counts[positive.as_py()].update(features(text.as_py() or ""))
            if len(counts[True]) + len(counts[False]) > 150_000:
                yield out()
    yield out()


def _rows(names: tuple[str, ...]) -> Callable:
    index = {f: i for i, f in enumerate(names)}

    def run(batches):
        for batch in batches:
            rows = [sorted(index[f] for f in features(t.as_py() or "") if f in index) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["positive"], pa.array(rows, pa.list_(pa.int32()))], ["positive", "at"])

    return run


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, top: int = TOP) -> Model:
    """A model from the training fold of docs and labels."""
    with C.Scratch():
        return _train(docs, labels, text_col, id_col, label_col, positives, unlabelled, top)


def _train(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, positives: int, unlabelled: int, top: int) -> Model:
    spark = docs.sparkSession
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = lab.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not n_toxic:
        return Model((), np.zeros(0), -50.0)
    yes = lab.filter("toxic = 1").select("doc_id")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text", F.lit("sample")))
    # rows of least hash, equal ones once, however many rows an id has
    least = lambda hs, n, flag: hs.distinct().orderBy("h").limit(n).withColumn("positive", F.lit(flag))
    chosen_p = least(rows.select("doc_id", "h").join(yes, "doc_id", "left_semi").select("h"), positives, True)
    chosen = C.written(chosen_p.unionByName(least(rows.select("h"), unlabelled, False)), "chosen")
    # at most positives + unlabelled rows of a hash and a flag: small enough to broadcast by its bound
    sample = C.written(rows.join(F.broadcast(chosen), "h").select("text", "positive").distinct(), "sample")
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    np_, nu = sizes.get(True, 0), sizes.get(False, 0)
    if not np_ or not nu:
        return Model((), np.zeros(0), 50.0 if np_ else -50.0)
    counts = sample.mapInArrow(C.tidy(_count), "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    # how far each feature's share among positives departs from its share among the others, in deviations
    pooled = (F.col("p") + F.col("u") + 1) / F.lit(float(np_ + nu + 2))
    z = (F.col("p") / F.lit(float(np_)) - F.col("u") / F.lit(float(nu))) / F.sqrt(pooled * (1 - pooled) * F.lit(1 / np_ + 1 / nu))
    prior = n_toxic / n
    # the share of a feature's documents that are toxic, were the sample the corpus
    purity = F.col("p") / F.lit(float(np_)) * F.lit(prior) / ((F.col("u") + F.lit(0.5)) / F.lit(float(nu)))
    best = counts.select("f", z.alias("z"), purity.alias("purity")).filter((F.col("z") >= LEAST_Z) & (F.col("purity") >= LEAST_PURITY)).orderBy(F.desc("z"), "f").limit(top).collect()
    names = tuple(r["f"] for r in best)
    rows = sample.mapInArrow(C.tidy(_rows(names)), "positive boolean, at array<int>").collect()
    x, positive = np.zeros((len(rows), len(names)), np.float32), np.zeros(len(rows), bool)
    for i, r in enumerate(sorted(rows, key=lambda r: (r["positive"], r["at"]))):
        x[i, r["at"]], positive[i] = 1, r["positive"]
    w, b = fit_nnpu(x, positive, prior)
    return Model(names, w, b)


def _score(model: Model, keep: tuple[str, ...]) -> Callable:
    def run(batches):
        score = model.scorer()
        for batch in batches:
            s = [score(t.as_py() or "") for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(s, pa.float64())], [*keep, "score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    keep = tuple(c for c in docs.columns if c not in ("score", "predicted"))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    scored = docs.select(*keep, docs[text_col].cast("string").alias(C.unused(keep))).mapInArrow(C.tidy(_score(model, keep)), schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
