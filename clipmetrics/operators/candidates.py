"""Candidate records: merge, union, filter, enrich."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmetrics.functions import text
from clipmetrics.functions.text import strip
from clipmetrics.params import SearchFilters
from clipmetrics.schemas import COUNTER_FIELDS, STRING_FIELDS


def merge_key(collapse_blank: bool = True) -> tuple[Column, Column]:
    """(platform, id or address); rows with neither share one key per platform unless switched off."""
    platform = F.lower(strip(F.coalesce(F.col("platform"), F.lit(""))))
    ident = strip(F.coalesce(F.col("video_id"), F.lit("")))
    link = strip(F.coalesce(F.col("url"), F.lit("")))
    key = F.when(ident != "", ident).otherwise(link)
    if not collapse_blank:
        key = F.when(key == "", F.concat(F.lit("#"), F.col("seq").cast("string"))).otherwise(key)
    return platform.alias("merge_platform"), key.alias("merge_key")


def merge_aggregates() -> list[Column]:
    """First known value per text field and duration, largest counters, latest date, first identity."""
    seq = F.col("seq")
    # Comparing struct(seq, value) keeps value and order together, and a null value never wins.
    first = lambda value: F.min(F.when(value.isNotNull(), F.struct(seq, value.alias("v")))).v
    identity = F.min(F.struct(seq, F.col("video_id"), F.col("platform"), F.col("media_type")))
    return [
        F.min(seq).alias("seq"),
        identity.video_id.alias("video_id"), identity.platform.alias("platform"), identity.media_type.alias("media_type"),
        *[first(F.nullif(F.col(c), F.lit(""))).alias(c) for c in STRING_FIELDS],
        first(F.nullif(F.col("duration_sec"), F.lit(0))).alias("duration_sec"),
        *[F.max(c).alias(c) for c in COUNTER_FIELDS],
        F.max("published_at").alias("published_at"),
    ]


def merge_candidates(hits: DataFrame, by: list[str] | None = None, collapse_blank: bool = True) -> DataFrame:
    """One record per video. Only partial aggregates are shuffled, so a key with many copies is no hot spot."""
    platform, key = merge_key(collapse_blank)
    extra = by or []
    return hits.groupBy(*extra, platform, key).agg(*merge_aggregates()).drop("merge_platform", "merge_key")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    order_cols = [F.col(c) for c in order]
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("_row"))
    return packed.select(*keys, "_row.*").select(*df.columns)


def distinct_phrases(df: DataFrame, group: list[str], phrase: str, order: list[str]) -> DataFrame:
    """Case-insensitive distinct, first spelling kept."""
    keyed = df.withColumn("_key", F.lower(strip(F.col(phrase)))).where(F.col("_key") != "")
    return keep_first(keyed, [*group, "_key"], order).drop("_key")


def known(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(0))


def filter_condition(filters: SearchFilters, now: Column) -> Column:
    """Unknown views, duration and date pass; unknown likes count as none."""
    ok = F.lit(True)
    if filters.min_views:
        ok = ok & (known("views").isNull() | (F.col("views") >= filters.min_views))
    if filters.min_likes:
        ok = ok & (F.coalesce(F.col("likes"), F.lit(0)) >= filters.min_likes)
    if filters.max_duration_sec:
        ok = ok & (F.col("duration_sec").isNull() | (F.col("duration_sec") <= filters.max_duration_sec))
    if filters.published_within_days:
        # A plain comparison with a constant, so it can reach the scan.
        oldest = now.cast("timestamp") - F.expr(f"interval {filters.published_within_days} days")
        ok = ok & (F.col("published_at").isNull() | (F.col("published_at") >= oldest))
    return ok


def filter_candidates(df: DataFrame, filters: SearchFilters, now: Column) -> DataFrame:
    return df.where(filter_condition(filters, now))


def of_channel(df: DataFrame, channel: str) -> DataFrame:
    """Rows of exactly this creator; a blank name has no rows."""
    wanted = text.channel_name(F.lit(channel))
    return df.where((wanted != "") & (text.channel_name(F.coalesce(F.col("author"), F.lit(""))) == wanted))


def of_channels(df: DataFrame, channels: DataFrame, name: str = "channel") -> DataFrame:
    """Rows of many creators at once: equi join on the normalised name."""
    wanted = channels.select(text.channel_name(F.col(name)).alias("_channel")).where(F.col("_channel") != "").distinct()
    keyed = df.withColumn("_channel", text.channel_name(F.coalesce(F.col("author"), F.lit(""))))
    return keyed.join(wanted, "_channel", "left_semi").drop("_channel")


def processable(df: DataFrame) -> DataFrame:
    """Image posts removed."""
    return df.where(F.lower(strip(F.coalesce(F.col("media_type"), F.lit("")))) != "image")


def triage(df: DataFrame) -> DataFrame:
    """Accept column and the reason of a rejection."""
    image = F.lower(strip(F.coalesce(F.col("media_type"), F.lit("")))) == "image"
    return df.withColumn("accepted", ~image).withColumn("reason", F.when(image, "image post"))


def union_sources(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def fill_distinct(tiers: list[DataFrame], key: Column, group: list[str], limit: int) -> DataFrame:
    """Ordered distinct union of several tiers, at most limit rows per group; rows without key are skipped.

    row_number with a constant bound lets Spark drop surplus rows before the shuffle.
    """
    tagged = union_sources(*[t.withColumn("_tier", F.lit(i)) for i, t in enumerate(tiers)])
    keyed = tagged.withColumn("_key", key).where(F.col("_key").isNotNull())
    first = keep_first(keyed, [*group, "_key"], ["_tier", "seq"])
    order = Window.partitionBy(*group).orderBy("_tier", "seq") if group else None
    if order is None:
        return first.orderBy("_tier", "seq").limit(limit).drop("_tier", "_key")
    ranked = first.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit)
    return ranked.drop("_tier", "_key", "_rank")


def by_url(tiers: list[DataFrame], group: list[str], limit: int) -> DataFrame:
    return fill_distinct(tiers, F.nullif(F.col("url"), F.lit("")), group, limit)


def by_id_or_url(tiers: list[DataFrame], group: list[str], limit: int) -> DataFrame:
    key = F.coalesce(text.blank_to_null(F.col("video_id")), text.blank_to_null(F.col("url")))
    return fill_distinct(tiers, key, group, limit)


def merge_preview(original: DataFrame, enriched: DataFrame) -> DataFrame:
    """Known enriched values override the candidate's own; rows without preview stay as they are."""
    texts = ["title", "author", "thumbnail", "media_type"]
    numbers = ["duration_sec", *COUNTER_FIELDS]
    fresh = enriched.select(
        "seq",
        F.nullif(F.col("video_id"), F.lit("")).alias("e_video_id"),
        *[F.nullif(F.col(c), F.lit("")).alias(f"e_{c}") for c in texts],
        *[F.when(F.col(c) > 0, F.col(c)).alias(f"e_{c}") for c in numbers],
        F.col("published_at").alias("e_published_at"),
    )
    joined = original.join(fresh, "seq", "left")
    merged = {c: F.coalesce(F.col(f"e_{c}"), F.col(c)) for c in ["video_id", *texts, *numbers, "published_at"]}
    return joined.withColumns(merged).select(*original.columns)
