"""Scores, sort orders and top lists, for one query or many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmetrics.functions import scoring
from clipmetrics.session import written

RAW = ["raw_engagement", "raw_velocity"]
SCORES = ["engagement", "recency", "relevance", "affiliate", "trend", "overall"]


def _raw(df: DataFrame, now: Column) -> DataFrame:
    with_engagement = df.withColumn("_engagement", scoring.engagement_raw())
    return with_engagement.withColumn("_velocity", scoring.velocity_raw(F.col("_engagement"), now))


def with_raw(df: DataFrame, now: Column) -> DataFrame:
    """The two quantities whose maxima the scores are normalised by."""
    return _raw(df, now).withColumnsRenamed({"_engagement": RAW[0], "_velocity": RAW[1]})


def _maxima(raw: DataFrame, by: list[str]) -> DataFrame:
    return raw.groupBy(*by).agg(F.max("_engagement").alias("_top_e"), F.max("_velocity").alias("_top_v"))


def score(df: DataFrame, query: Column, now: Column, by: list[str] | None = None) -> DataFrame:
    """Add the six scores. Maxima are an aggregate over the filtered rows, never a global window.

    df, merged and filtered and so far smaller than what arrived, is written once and serves both its rows and the
    maxima. Without by the maxima are one row read as scalar subqueries; with by they are one row per query, joined
    back in the way Spark's own size checks choose.
    """
    raw = _raw(written(df, "candidates"), now)
    if by:
        # Written, their size is known beforehand: a small table is sent to the rows, and these are not dealt by query.
        raw = raw.join(written(_maxima(raw, by), "maxima"), by)
        top_e, top_v = F.col("_top_e"), F.col("_top_v")
    else:
        tops = raw.agg(F.struct(F.max("_engagement").alias("e"), F.max("_velocity").alias("v")).alias("m"))
        top = tops.scalar()
        top_e, top_v = top.e, top.v
    parts = scoring.prepared(raw, query).withColumns({
        "_e": scoring.normalized(F.col("_engagement"), top_e),
        "_v": scoring.normalized(F.col("_velocity"), top_v),
        "_r": scoring.recency(now),
        "_m": scoring.relevance(),
        "_a": scoring.commerce(),
    })
    parts = parts.withColumn("_t", scoring.clamp01(0.45 * F.col("_e") + 0.35 * F.col("_r") + 0.20 * F.col("_v")))
    total = scoring.clamp01(0.32 * F.col("_t") + 0.24 * F.col("_m") + 0.14 * F.col("_e") + 0.30 * F.col("_a"))
    scored = parts.withColumns({
        "engagement": scoring.percent(F.col("_e")),
        "recency": scoring.percent(F.col("_r")),
        "relevance": scoring.percent(F.col("_m")),
        "affiliate": scoring.percent(F.col("_a")),
        "trend": scoring.percent(F.col("_t")),
        "overall": scoring.percent(total),
    })
    return scored.drop(*[c for c in scored.columns if c.startswith("_")])


def sort_key(mode: str) -> Column:
    """Descending sort column of a mode; an unknown mode sorts by the overall score."""
    keys = {
        "latest": F.coalesce(F.unix_seconds(F.col("published_at").cast("timestamp")), F.lit(0)),
        "likes": F.coalesce(F.col("likes"), F.lit(0)),
        "views": F.coalesce(F.col("views"), F.lit(0)),
        "affiliate": F.col("affiliate"),
    }
    return keys.get(mode.strip().lower(), F.col("overall"))


def top(df: DataFrame, mode: str = "overall", limit: int = 30) -> DataFrame:
    """First rows of one ranking, as many as asked for; ties keep arrival order. params.search_limit bounds a request."""
    return df.orderBy(sort_key(mode).desc(), F.col("seq").asc()).limit(limit)


def top_per_mode(df: DataFrame, modes: list[str], limit: int = 30) -> DataFrame:
    """First rows of several rankings of the same rows, in one pass; the column mode names the ranking."""
    keyed = F.array(*[F.struct(F.lit(m).alias("mode"), sort_key(m).cast("double").alias("_key")) for m in modes])
    order = Window.partitionBy("mode").orderBy(F.col("_key").desc(), F.col("seq").asc())
    ranked = df.select("*", F.inline(keyed)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit).drop("_key")


def top_per_query(df: DataFrame, by: list[str], mode: str = "overall", limit: int = 30) -> DataFrame:
    """First rows of many rankings. The bound on the row number is applied before the shuffle too."""
    order = Window.partitionBy(*by).orderBy(sort_key(mode).desc(), F.col("seq").asc())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def newest_first(df: DataFrame, column: str = "created_at") -> DataFrame:
    return df.orderBy(F.col(column).desc(), *[F.col(c) for c in ("job_id", "seq") if c in df.columns])
