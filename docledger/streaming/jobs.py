"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import filled
from ..plans.extract import JobConfig, extract
from ..sources.documents import with_names


def spread(docs: DataFrame) -> DataFrame:
    """Documents dealt to all cores by their id: a micro-batch of few files would be as few tasks, and reading fields costs far more than
    moving a text."""
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id")


def ingest_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, cfg: JobConfig, files_per_batch: int = 100) -> StreamingQuery:
    """Documents as they arrive, one row each, appended as Parquet. Stateless, so the source's offsets and the sink's log make it exact."""
    docs = with_names(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))
    rows = extract(spread(docs), cfg).drop("text")
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_counts(rows: DataFrame) -> DataFrame:
    """Running counts by job, platform and method; for a stream in update or complete mode, and for a batch."""
    return rows.groupBy("job_id", F.coalesce(filled("_platform"), F.lit("UNKNOWN")).alias("platform"), F.coalesce(filled("_extraction_method"), F.lit("unknown")).alias("method")).agg(F.count("*").alias("rows"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type with a watermark, so the state stays bounded."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    held = timed.withWatermark("ts", late) if events.isStreaming else timed
    return held.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def expire_jobs(jobs: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """Jobs not older than the limit; a job's time is that of its end, else its last change, else its start."""
    at = F.coalesce(*(F.col(c) for c in ("finished_at", "updated_at", "created_at") if c in jobs.columns))
    return jobs.where(at >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))


SESSION_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def expired_jobs(events: DataFrame, ttl_seconds: int, late: str = "1 hour", job: str = "job_id") -> DataFrame:
    """(job, first_at, last_at, events) of each job that was idle for longer than the limit, for a stream in append mode.

    A job's time is that of its end, else its last change, else its start. The state holds the live jobs only; the watermark, which the
    events of all jobs move, lets a job expire without an event of its own. One that wakes up afterwards lives and expires anew. Events
    without a time or job are left out; those later than ``late`` no longer wake a job that has expired. In a batch all jobs are given."""
    at = F.coalesce(*(F.col(c).cast("timestamp") for c in ("finished_at", "updated_at", "created_at") if c in events.columns))
    timed = events.select(F.col(job), at.alias("__at")).where(F.col("__at").isNotNull() & F.col(job).isNotNull())
    # events are dealt by job and time: one large file would be sorted by one task, and by job alone a busy one would be a single task's
    cores = events.sparkSession.sparkContext.defaultParallelism
    held = timed.withWatermark("__at", late).repartition(cores, job, "__at") if events.isStreaming else timed
    idle = held.groupBy(F.session_window("__at", f"{int(ttl_seconds)} seconds"), job).agg(F.min("__at").alias("first_at"), F.max("__at").alias("last_at"), F.count("*").alias("events"))
    return idle.select(job, "first_at", "last_at", "events")


def start_expiry(expired: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Expired jobs appended as Parquet. Sessions are merged in each task before they are shuffled, so a busy job is not one task's work."""
    conf = expired.sparkSession.conf
    before = conf.get(SESSION_MERGE)
    conf.set(SESSION_MERGE, "true")  # a stream keeps the settings that it starts with
    try:
        return expired.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(SESSION_MERGE, before)


def without_expired(rows: DataFrame, expired: DataFrame, at: str, job: str = "job_id") -> DataFrame:
    """Rows of jobs that have not expired since; rows without a job or time stay."""
    last = expired.groupBy(job).agg(F.max("last_at").alias("__last"))
    joined = rows.hint("merge").join(last.hint("merge"), job, "left")
    return joined.where(F.col("__last").isNull() | F.col(at).isNull() | (F.col(at) > F.col("__last"))).drop("__last")
