"""Streams: current job state, change feed, transcript windows, incremental ingest.

Each keeps state by key with an event-time timeout, so state is bounded; what is older than the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dossier_spark.operators.transcripts import CLOSE_AFTER, GAP

STATE = "job_id string, status string, message string, progress long, version long, updated_at timestamp"
FEED = "job_id string, ts timestamp, seq long, status string, message string, version long"
KNOWN = ("status", "message", "progress", "version")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobState(StatefulProcessor):
    """What is known of a job: its columns' latest values and when it was last updated, one state value that is read and written once
    a batch and gone `expire` after the last update. feed says whether the events that change something are returned, or the state
    after a batch."""

    def __init__(self, expire: str, feed: bool):
        self.ms, self.feed = int(pd.Timedelta(expire).total_seconds() * 1000), feed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, message string, progress long, version long, at long, seq long, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *known, at, seq, due = self.job.get() or (None, None, None, None, -1, -1, 0)
        new = []
        for pdf in rows:
            micros = pdf["ts"].astype("datetime64[us]").astype("int64").tolist()
            told = [[None if v is None or v != v else kind(v) for v in pdf[c].tolist()] for c, kind in zip(KNOWN, (str, str, int, int), strict=True)]
            new += [(m, n, s, t or None, p, v) for m, n, s, t, p, v in zip(micros, pdf["seq"].tolist(), *told, strict=True) if (m, n) > (at, seq)]  # what is late changes nothing
        if not new:
            return
        new.sort(key=lambda r: r[:2])
        out = []
        for m, n, *told in new:
            news = any(told[i] is not None and told[i] != known[i] for i in (0, 1, 3))  # status, message, version
            known = [k if t is None else t for t, k in zip(told, known, strict=True)]
            if self.feed and news:
                out.append((m, n, known[0], known[1], known[3]))
        at, seq = new[-1][:2]
        if due:
            self.handle.deleteTimer(due)
        due = max(at // 1000, timerValues.getCurrentWatermarkInMs()) + self.ms
        self.handle.registerTimer(due)
        self.job.update((*known, at, seq, due))
        time = lambda v: pd.Series(v, dtype="int64").astype("datetime64[us]")
        if not self.feed:
            yield pd.DataFrame({"job_id": [key[0]], **{c: pd.array([v], dtype="Int64" if c in ("progress", "version") else object) for c, v in zip(KNOWN, known, strict=True)}, "updated_at": time([at])})
            return
        ts, number, status, message, version = zip(*out, strict=True) if out else [()] * 5
        yield pd.DataFrame({"job_id": [key[0]] * len(out), "ts": time(ts), "seq": pd.array(number, dtype="Int64"), "status": pd.array(status, dtype=object), "message": pd.array(message, dtype=object), "version": pd.array(version, dtype="Int64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def _followed(events: DataFrame, expire: str, feed: bool, schema: str, mode: str) -> DataFrame:
    """Job events through JobState. Its state store must be RocksDB, as for all of transformWithState."""
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    e = events.select("job_id", "ts", "seq", *KNOWN).withWatermark("ts", expire)
    return e.groupBy("job_id").transformWithStateInPandas(JobState(expire, feed), schema, mode, "EventTime")


def current_state(events: DataFrame, expire: str = "24 hours") -> DataFrame:
    """State of each job after each batch that has news of it, in update mode; partial updates keep the other columns, late ones
    are ignored, and `expire` after its last update a job is forgotten (ST1). events: job_id, ts, seq, status, message, progress, version."""
    return _followed(events, expire, False, STATE, "update")


def change_feed(events: DataFrame, expire: str = "24 hours") -> DataFrame:
    """The events that change a job's status, message or version, with its state after them (ST4); as operators.jobs.changes."""
    return _followed(events, expire, True, FEED, "append")


def transcript_windows(segments: DataFrame, close_after: float = CLOSE_AFTER, gap: float = GAP, idle: str = "10 minutes") -> DataFrame:
    """Windows of timed segments (source_id, ts, seq, start, end, text); the last one is flushed when a source falls silent (ST3)."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def row(key, no, parts):
        return (key[0], no, float(parts[0][0]), float(max(p[1] for p in parts)), " ".join(p[2] for p in parts))

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        no, starts, ends, texts = state.get if state.exists else (0, [], [], [])
        parts, rows = list(zip(starts, ends, texts, strict=True)), []
        if state.hasTimedOut:
            if parts:
                rows.append(row(key, no, parts))
            state.remove()
        else:
            last = 0
            for r in pd.concat(list(pdfs)).sort_values(["start", "seq"]).itertuples():
                last = max(last, r.ts.value // 1_000_000)
                text = (r.text or "").strip()
                if not text:
                    continue
                if parts and r.start - parts[-1][1] >= gap:
                    rows.append(row(key, no, parts))
                    no, parts = no + 1, []
                had = bool(parts)
                parts.append((r.start, r.end, text))
                if had and max(p[1] for p in parts) - parts[0][0] >= close_after:
                    rows.append(row(key, no, parts))
                    no, parts = no + 1, []
            state.update((no, [float(p[0]) for p in parts], [float(p[1]) for p in parts], [p[2] for p in parts]))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + ms)
        yield pd.DataFrame(rows, columns=["source_id", "window_no", "start", "end", "text"])

    return segments.withWatermark("ts", idle).groupBy("source_id").applyInPandasWithState(step, "source_id string, window_no int, start double, end double, text string", "no int, starts array<double>, ends array<double>, texts array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def new_files(spark: SparkSession, folder: str, schema: str, per_trigger: int = 25, late: str = "7 days") -> DataFrame:
    """Listing records (path, mtime, …) that arrive as JSON files in a folder, at most per_trigger files at a time; a path counts once (ST2)."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)
    return s.withWatermark("mtime", late).dropDuplicatesWithinWatermark(["path"]).filter(F.col("path").isNotNull())
