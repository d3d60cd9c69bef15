"""The corpus pipeline: documents to token ids in five stages, each written as Parquet before the next reads it.

Toxic documents go; of each near-duplicate group one document stays; passages that repeat are cut out; sources
are mixed to their weights (no document is lost, small sources repeat up to twice); what is left is encoded.

Defined results: columns that documents have beside their own are carried through every stage unchanged, whatever
they are called; the last stage replaces those named like one of its outputs. Null texts count as empty, null sources
as a source of their own; with no documents every stage is empty.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier_spark.llm import bpe, common, mixing, near_dedup, substring_dedup, toxicity

OWN = ("doc_id", "text", "lang", "source", "n_chars")
REST = "columns_set_aside"


def set_aside(docs: DataFrame) -> DataFrame:
    """docs with its own columns, and all others in one struct, so that none clashes with what a stage adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in OWN]
    own = [c for c in docs.columns if c in OWN]
    return docs.select(*own, F.struct(*others).alias(REST)) if others else docs.select(*own)


def put_back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order."""
    return out.select(*[F.col(c) if c in OWN else F.col(f"{REST}.`{c}`").alias(c) for c in docs.columns])


def bounded(stage):
    """The stage in small Arrow batches: executors and workers serve all stages, and what each leaves adds up."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this input, does not reject."""
    model = toxicity.train(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return put_back(toxicity.score(set_aside(docs), model).filter("predicted = 0"), docs)


@bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of least id; documents without words are in no group."""
    return near_dedup.drop_duplicates(docs)


@bounded
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that also occur elsewhere; untouched ones keep their text as it is."""
    cut = substring_dedup.remove_repeated_passages(set_aside(docs))
    return put_back(cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")), docs)


@bounded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix asks."""
    return put_back(mixing.mix(set_aside(docs)), docs)


@bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digest and that of the decoded text. Workers keep small tables, since
    they also serve the other stages."""
    return bpe.encode(docs, outputs=("ids", "ids_sha256", "decoded_sha256"), tables=(40_000, 40_000))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

# Similarity classes, hashes of windows and token ids are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
