"""What the pipeline's stages leave to each other in an executor: batches of whole texts, and what workers keep."""

import corpus_pipeline as cp
import pyarrow as pa
from dossier_spark.llm import bpe
from dossier_spark.llm import common as C

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def longest(batches):
    yield pa.RecordBatch.from_pydict({"n": [max((b.num_rows for b in batches), default=0)]}, pa.schema([("n", pa.int64())]))


def test_every_stage_takes_small_batches(spark, sf):
    docs, before = spark.read.parquet(f"{sf}/documents.parquet").limit(3), spark.conf.get(KEY)
    try:
        for name, stage in cp.STAGES:
            spark.conf.set(KEY, 10_000)
            stage(spark, docs, sf)
            assert spark.range(0, 5000, 1, 1).mapInArrow(longest, "n long").first().n <= C.BATCH_ROWS, name
        spark.conf.set(KEY, 7)
        C.small_batches(spark)
        assert spark.conf.get(KEY) == "7"  # the user's own
    finally:
        spark.conf.set(KEY, before)


def test_tasks_drop_what_others_kept():
    first = lambda run: list(run(iter([1])))
    c = bpe.codec(bpe.default_path(), r"\w+|\W+", 10, 10)
    same = lambda batches: (bpe.codec(bpe.default_path(), r"\w+|\W+", 10, 10) is c for _ in batches)
    assert first(C.tidy(same, bpe.OWNER)) == [True]  # the operator's next task has it
    first(C.tidy(iter))
    assert first(C.tidy(same, bpe.OWNER)) == [False]
    C.tidy_groups(lambda table: table)(0)
    assert C._KEPT == {}
