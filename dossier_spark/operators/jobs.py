"""Job status events: current state, changes, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import carried, spread_by_order

SEEN = ("status", "message", "version")
# Queue states and the states that users see.
STATUS = {"queued": "pending", "deferred": "pending", "scheduled": "pending", "started": "extracting", "finished": "completed", "failed": "failed", "stopped": "failed", "canceled": "failed"}


def shown_status(c: Column, default: str = "pending") -> Column:
    """The state a user sees for a queue's."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.lower(c)], F.lit(default))


def current(events: DataFrame) -> DataFrame:
    """Latest state of each job: newest status, last non-null of the other columns.
    events: job_id, ts, seq, status, message, progress. Grouped maxima: partial before the shuffle, so hot jobs are cheap."""
    at = F.struct("ts", "seq")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return events.groupBy("job_id").agg(F.max_by("status", at).alias("status"), last("message"), last("progress"), F.max("ts").alias("updated_at"))


def changes(events: DataFrame) -> DataFrame:
    """The events that change what a watcher of the job sees, with the state after them: (job_id, ts, seq, status, message,
    version) (W10, ST4).

    An event is a partial update: null columns, and an empty message, leave what is known. It is a change if its message,
    version or status is given and differs from the last one known of the job. events: job_id, ts, seq, status, message, version.
    """
    order = ["ts", "seq"]
    e = spread_by_order(events.select("job_id", *order, "status", F.nullif("message", F.lit("")).alias("message"), "version"), "job_id", order)
    known = carried(e, "job_id", order, {f"last_{c}": F.col(c) for c in SEEN})
    new = [F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"last_{c}")) for c in SEEN]
    return known.filter(new[0] | new[1] | new[2]).select("job_id", *order, *[F.coalesce(c, f"last_{c}").alias(c) for c in SEEN])


def field_stages(events: DataFrame) -> DataFrame:
    """Latest stage of each field of a job, label of its first event, fields in first-seen order.
    events: job_id, field_key, seq, label, stage."""
    g = events.groupBy("job_id", "field_key").agg(F.min("seq").alias("first_seq"), F.min_by("label", "seq").alias("label"), F.max_by("stage", "seq").alias("stage"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("first_seq")))


def progress(stages: DataFrame, done: tuple[str, ...] = ("done", "warning", "error")) -> DataFrame:
    """Share of finished fields as progress between 0.4 and 0.7."""
    ratio = F.count_if(F.col("stage").isin(*done)) / F.count("*")
    return stages.groupBy("job_id").agg(F.greatest(F.lit(0.4), F.least(F.lit(0.7), 0.4 + 0.3 * ratio)).alias("progress"))


def metadata(c: Column) -> Column:
    """A JSON object of strings; {} for anything else."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def ingestion_counts(files: DataFrame) -> DataFrame:
    """(source, txt, json): how many text and JSON files were ingested of each source; others are not (A23). files: source, suffix."""
    kind = lambda s: F.count_if(F.lower("suffix") == s)
    return files.groupBy("source").agg(kind(".txt").alias("txt"), kind(".json").alias("json"))
