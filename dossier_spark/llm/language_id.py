"""Language identification by nearest centroids.

A text is a vector of hashed letter n-grams (1 to 3 bytes of its lower-cased letters and the gaps between
words), weighted by damped TF-IDF and scaled to length 1. Each language has several centroids, found by
spherical k-means on a bounded sample of its training texts (PER_LANGUAGE rows by hash, a parameter), each language in a
task of its own; there may be any number of languages. A text gets the language of the nearest centroid by cosine; score is that cosine, from 0 to 1. Distance-based
rejection: below `reject_below` the language is `und`; it is 0 by default, so only texts without letters are.

Defined results: a null text or one without a letter is `und` with score 0, as is all if nothing was learned.
Texts of any length are read whole. Ties go to the smaller language code. Rows with null lang teach nothing.
Columns of the input are returned unchanged, but those named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

PER_LANGUAGE, CENTROIDS, BINS = 800, 4, 1 << 12
THINNED = 3  # rows ranked for each row taken
BROADCAST_LANGS = 1 << 19
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[0x80:] = np.arange(0x80, 0x100)
BLOCK = 1 << 18


def held_out(id_col: str = "doc_id"):
    """crc32(doc_id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def counts(text: str, bins: int = BINS) -> np.ndarray:
    """How often each hashed n-gram of one, two and three bytes occurs; gaps alone do not count."""
    raw = LETTERS[np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)]
    out = np.zeros(bins, np.int64)
    for lo in range(0, len(raw), BLOCK):
        x = raw[lo : lo + BLOCK + 2].astype(np.uint32)
        here = min(BLOCK, len(raw) - lo)
        word = x != 0x20
        grams = [x, x[:-1] << 8 | x[1:], x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
        held = [word, word[:-1] | word[1:], word[:-2] | word[1:-1] | word[2:]]
        for n, (g, ok) in enumerate(zip(grams, held, strict=True)):
            g, ok = g[:here], ok[:here]
            h = (g * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B * (n + 1) & 0xFFFFFFFF)) >> np.uint32(16)
            out += np.bincount((h * np.uint32(bins) >> np.uint32(16))[ok], minlength=bins)
    return out


def weigh(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def centroids_of(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; starts spread out from the mean, always at the row least like those chosen."""
    mean = x.mean(axis=0)
    chosen = [x[int(np.argmax(x @ mean))]]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[int(np.argmin((x @ np.array(chosen).T).max(axis=1)))])
    c = np.array(chosen)
    for _ in range(rounds):
        nearest = np.argmax(x @ c.T, axis=1)
        c = np.array([x[nearest == i].mean(axis=0) if (nearest == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return np.concatenate([c, mean[None] / max(np.linalg.norm(mean), 1e-12)])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    centroids: np.ndarray
    idf: np.ndarray
    reject_below: float = 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        cosines = self.centroids @ weigh(counts(text, len(self.idf)), self.idf).astype(np.float32)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return (self.languages[best] if score >= self.reject_below else UNKNOWN), score


def _vectors(batches):
    for batch in batches:
        rows = [counts(t.as_py() or "").astype(np.int32) for t in batch["text"]]
        at = [np.flatnonzero(r).astype(np.int32) for r in rows]
        yield pa.RecordBatch.from_arrays([batch["lang"], C.binaries(at), C.binaries(r[i] for r, i in zip(rows, at, strict=True))], ["lang", "at", "n"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, reject_below: float = 0.0) -> Model:
    """A model from the training fold: at most per_language texts of each language, those of least hash.

    Rows are first thinned by a threshold on that hash, set from the language's count so that about THINNED times as many
    pass, and equal rows are put together; so a task that ranks a language has a bounded number of rows, however many
    there are. A language of which too few pass, because rows repeat, is thinned again by the count of its distinct rows.
    Each language is fitted by itself, in a task; the driver holds the centroids alone (80 KB a language).
    """
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    ids = ids.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).withColumn("h", F.xxhash64("doc_id", "text", F.lit("sample")))

    def sampled(counts: DataFrame) -> DataFrame:
        """Rows of the languages counted (lang, n), thinned by n and ranked."""
        most = F.broadcast(counts) if counts.count() <= BROADCAST_LANGS else counts
        passing = ids.join(most, "lang").filter(F.col("h") / F.lit(2.0**64) + 0.5 <= F.lit(float(THINNED * per_language)) / F.col("n"))
        w = Window.partitionBy("lang").orderBy("h", "doc_id")
        return passing.dropDuplicates(["lang", "h"]).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_language).select("lang", "text")

    with C.Scratch():
        counts = C.written(ids.groupBy("lang").agg(F.count("*").alias("n")), "counts")
        sample = C.written(sampled(counts), "sample")
        have = sample.groupBy("lang").agg(F.count("*").alias("have"))
        few = counts.join(have, "lang", "left").filter((F.col("n") > THINNED * per_language) & (F.coalesce("have", F.lit(0)) < per_language)).select("lang")
        again = C.written(ids.join(F.broadcast(few), "lang", "left_semi").groupBy("lang").agg(F.countDistinct("h").alias("n")), "again")
        if again.count():
            sample = C.written(sample.join(again, "lang", "left_anti").unionByName(sampled(again)), "sample")
        return _fit(C.written(sample.mapInArrow(_vectors, "lang string, at binary, n binary").filter(F.length("at") > 0), "vectors"), centroids, reject_below)


def _bins(batches):
    """How many vectors hold each bin."""
    for batch in batches:
        at = np.frombuffer(b"".join(batch["at"].to_pylist()), np.int32)
        n = np.bincount(at, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS), pa.int32()), pa.array(n, pa.int64())], ["bin", "n"])


def _centroids(idf: np.ndarray, k: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        held = sorted(zip(rows["at"].to_pylist(), rows["n"].to_pylist(), strict=True))
        x = np.zeros((len(held), BINS), np.float32)
        for i, (at, n) in enumerate(held):
            x[i, np.frombuffer(at, np.int32)] = np.frombuffer(n, np.int32)
        c = centroids_of(weigh(x, idf).astype(np.float32), k).astype(np.float32)
        return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * len(c), pa.string()), "place": pa.array(np.arange(len(c)), pa.int32()), "centroid": C.binaries(c)})

    return run


def _fit(vectors: DataFrame, centroids: int, reject_below: float) -> Model:
    n = vectors.count()
    holders = np.zeros(BINS)
    for r in vectors.mapInArrow(_bins, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        holders[r["bin"]] = r["n"]
    idf = np.log((1 + n) / (1 + holders)).astype(np.float32) + 1
    rows = vectors.groupBy("lang").applyInArrow(C.tidy_groups(_centroids(idf, centroids)), "lang string, place int, centroid binary").orderBy("lang", "place").collect()
    found = np.zeros((len(rows), BINS), np.float32)
    for i, r in enumerate(rows):
        found[i] = np.frombuffer(r["centroid"], np.float32)
    return Model(tuple(r["lang"] for r in rows), found, idf, reject_below)


def _predict(model: Model, keep: tuple[str, ...]) -> Callable:
    def run(batches):
        for batch in batches:
            out = [model.predict(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], [*keep, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    keep = tuple(c for c in docs.columns if c not in ("lang_pred", "score"))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*keep, docs[text_col].cast("string").alias(C.unused(keep))).mapInArrow(_predict(model, keep), schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
