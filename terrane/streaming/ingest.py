"""Streaming extensions: commits and trace events as they arrive, merged idempotently. Batch parity needs none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "repo string, sha string, author string, date string, subject string, files array<struct<path:string,added:bigint,deleted:bigint>>, loaded_at timestamp"


def commit_stream(spark: SparkSession, path: str, late: str = "60 days") -> DataFrame:
    """Commits from JSON files as they land; redeliveries within the watermark dropped by (repo, sha)."""
    raw = spark.readStream.schema(COMMITS).json(path)
    return raw.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["repo", "sha"])


def monthly_activity(commits: DataFrame) -> DataFrame:
    """(repo, month, commits, files): running counts per repo and month, in update mode."""
    return commits.groupBy("repo", F.substring("date", 1, 7).alias("month")).agg(F.count("*").alias("commits"), F.sum(F.size("files")).alias("files"))


def windowed_calls(events: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """(window, event_type, calls, errors) of an (ts, event_type) stream, late events within the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("calls"), F.sum((F.col("event_type") == "error").cast("bigint")).alias("errors"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))


def run_into(stream: DataFrame, apply, checkpoint: str, once: bool = True):
    """Runs ``apply(batch_df)`` on each micro-batch; with ``once``, over all that has arrived and then stops."""
    w = stream.writeStream.foreachBatch(lambda df, _: apply(df)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
