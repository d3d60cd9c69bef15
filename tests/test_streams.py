"""Streams give what their batch twins give, also over several small batches."""

from pyspark.sql import functions as F

from dossier_spark.operators import transcripts as T
from dossier_spark.streaming import jobs as stream


def run(spark, df, mode):
    rows = []
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: rows.extend((n, *r) for r in b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows


def test_windows(spark, tmp_path):
    rows = [("s", i, float(7 * i + 3 * (i > 5)), float(7 * i + 6 + 3 * (i > 5)), f"w{i}") for i in range(20)]
    folder = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "source_id string, seq int, start double, end double, text string").withColumn("ts", F.expr("timestamp_seconds(1700000000 + start)"))
    for i in range(0, 20, 6):
        df.filter(f"seq >= {i} and seq < {i + 6}").coalesce(1).write.mode("append").parquet(folder)
    # a segment a day later, in a file of its own and last, lets the watermark pass the others
    flush = spark.createDataFrame([("other", 0, 0.0, 1.0, "z")], "source_id string, seq int, start double, end double, text string").withColumn("ts", F.expr("timestamp_seconds(1700900000)"))
    want = [tuple(r) for r in T.windows(df).orderBy("window_no").collect()]
    flush.coalesce(1).write.mode("append").parquet(folder)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = [r[1:] for r in run(spark, stream.transcript_windows(s), "append")]
    assert sorted((r for r in got if r[0] == "s"), key=lambda r: r[1]) == want


def test_new_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "path string").withColumn("mtime", F.expr("timestamp_seconds(1700000000)"))
    df.coalesce(1).write.json(folder)
    got = run(spark, stream.new_files(spark, folder, "path string, mtime timestamp"), "append")
    assert sorted(r[1] for r in got) == ["a", "b"]


JOBS = "job_id string, ts timestamp, seq long, status string, message string, progress long, version long"


def job_stream(spark, tmp_path, batches):
    """One file, and so one batch, for each list of (job, seconds, seq, status, message, progress, version)."""
    folder = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(j, float(t), *x) for j, t, *x in rows], "job_id string, s double, seq long, status string, message string, progress long, version long")
        df.select("job_id", F.expr("timestamp_seconds(1700000000 + s)").alias("ts"), "seq", "status", "message", "progress", "version").coalesce(1).write.mode("append").parquet(folder)
        import time

        time.sleep(1.1)  # files are taken by their time
    return spark.readStream.schema(JOBS).option("maxFilesPerTrigger", 1).parquet(folder)


BATCHES = [
    [("a", 0, 1, "queued", "m1", None, None), ("a", 5, 2, None, None, 10, None), ("b", 1, 3, "queued", None, None, 1)],
    [("a", 3, 4, "late", "late", 99, None), ("a", 9, 5, None, "m1", None, 1), ("b", 9, 6, "running", "", None, 1)],
    [("c", 200_000, 7, "queued", None, None, None)],  # two days later: the others are forgotten
    [("c", 200_001, 8, "queued", "x", None, None)],
    [("a", 200_002, 9, "queued", "m1", None, None)],
]


def test_current_state(spark, tmp_path):
    got = [(r[0], r[1], *r[2:6]) for r in run(spark, stream.current_state(job_stream(spark, tmp_path, BATCHES)), "update")]
    last = {}
    for r in got:
        last[r[1], r[0] >= 4] = r[2:]
    assert last["a", False] == (None, "m1", 10, 1) or last["a", False] == ("queued", "m1", 10, 1)
    assert last["b", False] == ("running", None, None, 1)
    assert last["a", True] == ("queued", "m1", None, None)  # nothing is left of the first day


def test_change_feed(spark, tmp_path):
    got = [(r[1], r[3], *r[4:]) for r in run(spark, stream.change_feed(job_stream(spark, tmp_path, BATCHES)), "append")]
    assert sorted(got, key=lambda r: r[1]) == [
        ("a", 1, "queued", "m1", None), ("b", 3, "queued", None, 1), ("a", 5, "queued", "m1", 1), ("b", 6, "running", None, 1), ("c", 7, "queued", None, None), ("c", 8, "queued", "x", None), ("a", 9, "queued", "m1", None),
    ]
