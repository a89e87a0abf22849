"""Candidate streams: running merge, repeat suppression, trend windows, ranking snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics.functions import scoring
from clipmetrics.operators import ranking
from clipmetrics.operators.candidates import merge_aggregates, merge_key
from clipmetrics.schemas import COUNTER_FIELDS, STRING_FIELDS
from clipmetrics.streaming.runs import latest

MERGE_KEYS = ["merge_platform", "merge_key"]


def merge_stream(hits: DataFrame) -> DataFrame:
    """One row per video, kept up to date; the state holds every video ever seen."""
    platform, key = merge_key()
    return hits.groupBy(platform, key).agg(*merge_aggregates())


FIRST_KNOWN = ["identity", *STRING_FIELDS, "duration_sec"]


def merge_parts(hits: DataFrame) -> DataFrame:
    """Hits in the form in which they can be merged in any order and any number of times: text fields keep the seq they
    came with, and all that merging does is to take minima and maxima."""
    platform, key = merge_key()
    seq = F.col("seq")
    known = lambda value: F.when(value.isNotNull(), F.struct(seq, value.alias("v")))
    return hits.select(
        platform, key, seq, F.struct(seq, "video_id", "platform", "media_type").alias("identity"),
        *[known(F.nullif(F.col(c), F.lit(""))).alias(c) for c in STRING_FIELDS],
        known(F.nullif(F.col("duration_sec"), F.lit(0))).alias("duration_sec"), *COUNTER_FIELDS, "published_at",
    )


def merge_of_parts(parts: DataFrame) -> DataFrame:
    """One row of parts per video."""
    latest_batch = [F.max("batch").alias("batch")] if "batch" in parts.columns else []
    return parts.groupBy(*MERGE_KEYS).agg(
        F.min("seq").alias("seq"), *[F.min(c).alias(c) for c in FIRST_KNOWN],
        *[F.max(c).alias(c) for c in [*COUNTER_FIELDS, "published_at"]], *latest_batch,
    )


def from_parts(parts: DataFrame) -> DataFrame:
    """Merged candidates as merge_candidates gives them."""
    return parts.select(
        "seq", "identity.video_id", "identity.platform", "identity.media_type",
        *[F.col(c).v.alias(c) for c in [*STRING_FIELDS, "duration_sec"]], *COUNTER_FIELDS, "published_at",
    )


def merge_sessions(hits: DataFrame, event_time: str, quiet: str, delay: str) -> DataFrame:
    """One final row per video and burst of hits: a video not seen for the quiet time leaves the state."""
    platform, key = merge_key()
    marked = hits.withWatermark(event_time, delay)
    return marked.groupBy(F.session_window(event_time, quiet).alias("seen"), platform, key).agg(*merge_aggregates()).drop("seen", *MERGE_KEYS)


def merged(spark: SparkSession, log: str) -> DataFrame:
    return latest(spark, log, MERGE_KEYS).drop(*MERGE_KEYS)


def suppress_repeats(hits: DataFrame, event_time: str, delay: str, keys: list[str]) -> DataFrame:
    """Rows whose key was not seen within the delay."""
    return hits.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def trend_windows(hits: DataFrame, event_time: str, delay: str, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Engagement inputs per platform and window, final once the watermark has passed the window."""
    marked = hits.withWatermark(event_time, delay)
    window = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    agg = marked.groupBy(window.alias("w"), "platform").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("likes").alias("likes"), F.sum("views").alias("views"), F.max(scoring.engagement_raw()).alias("top_engagement"),
    )
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "platform", "hits", "likes", "views", "top_engagement")


def snapshot_writer(query: Column, now: Column, limit: int = 30):
    """Ranking of everything merged so far, rewritten after each micro-batch next to the change log."""
    def write(spark: SparkSession, log: str, number: int) -> None:
        ranked = ranking.top(ranking.score(merged(spark, log), query, now), "overall", limit)
        ranked.write.mode("overwrite").parquet(f"{log}-snapshot/batch={number}")

    return write


def newest_snapshot(spark: SparkSession, log: str) -> DataFrame:
    """Rows of the last snapshot; only its partition is read."""
    folder = f"{log}-snapshot"
    snapshots = spark.read.option("basePath", folder).parquet(folder)
    last = snapshots.agg(F.max("batch").alias("b")).scalar()
    return snapshots.where(F.col("batch") == last).drop("batch")
