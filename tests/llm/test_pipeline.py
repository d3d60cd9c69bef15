import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

cp = pytest.importorskip("corpus_pipeline")

from dossier_spark.llm import mixing, toxicity  # noqa: E402

from . import test_mixing, test_near_dedup, test_substring_dedup  # noqa: E402


def test_stages(spark, sf):
    """Each stage against a brute-force version of it on what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, rows = docs.columns, [tuple(r) for r in docs.collect()]
    frames = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        docs.persist()
        frames[name] = [r.asDict() for r in docs.collect()]
        if name != "byte_bpe":
            assert docs.columns == cols
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    score = model.scorer()
    kept = [r for r in rows if score(r[1]) < toxicity.THRESHOLD]
    assert Counter(r["doc_id"] for r in frames["toxicity"]) == Counter(r[0] for r in kept)
    near = {d for d, _, c, k in test_near_dedup.brute([r[:2] for r in kept]) if k}
    assert {r["doc_id"] for r in frames["near_dedup"]} == near and len(frames["near_dedup"]) == len(near)
    left = [r for r in kept if r[0] in near]
    cut = {r["doc_id"]: r["text"] for r in frames["substring_dedup"]}
    for d, n, gone, sha in test_substring_dedup.brute([r[:2] for r in left]):
        words = re.findall(r"[^\x20\x09-\x0D]+", cut[d])
        assert len(words) == n - gone and hashlib.sha256(" ".join(words).encode()).hexdigest() == sha
    mixed = test_mixing.brute([(r["doc_id"], r["source"], r["text"]) for r in frames["substring_dedup"]])
    assert Counter(r["doc_id"] for r in frames["source_mixing"]) == Counter(r[0] for r in mixed)
    assert set(cut) == {r["doc_id"] for r in frames["source_mixing"]}
    assert len(frames["byte_bpe"]) == len(mixed)
    for r in frames["byte_bpe"]:
        assert r["decoded_sha256"] == hashlib.sha256(cut[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(r["ids"])
    assert mixing.MAX_REPEAT == 2.0


def test_clashing_columns(spark, sf):
    """Columns named like what a stage adds, or like its own, go through every stage unchanged."""
    extra = ["score", "predicted", "_row", "ka", "c", "n_words", "n_removed", "kept_text", "rest", "part", "mix_note", "mix_source", "mix_words", "columns_set_aside", "__source_text__", "a b", "n_shingles"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = docs
    for i, name in enumerate(extra):
        wide = wide.withColumn(name, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[x] == f"{i}:{r.doc_id}" for r in rows for i, x in enumerate(extra)), name
        plain = stage(spark, docs, sf).select("doc_id", "text")
        assert Counter((r.doc_id, r.text) for r in rows) == Counter(map(tuple, plain.collect())), name
    last = cp.encode(spark, wide.withColumn("ids", F.lit("x")), sf)
    assert last.columns.count("ids") == 1 and last.select("a b", "score").first() is not None


def test_null_ids_and_empty(spark, sf):
    """Near copies among rows without an id, equal rows, an id that two texts carry; and no rows at all."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "en", "s", 1), (None, text + " end", "en", "s", 1), (4, text, "en", None, 1), (5, "quite another text " * 9, "en", "s", 1), (5, text + " tail", "en", "s", 1), (6, None, None, None, None), (6, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.drop_near_duplicates(spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(4, text), (5, "quite another text " * 9), (6, ""), (6, "")])
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        assert stage(spark, docs, sf).count() > 0, name


def test_run(spark, sf):
    assert cp.run(spark, sf).columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
