"""Score expressions of the ranking operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmetrics import rules
from clipmetrics.functions import text
from clipmetrics.functions.text import strip


def clamp01(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def normalized(col: Column, top: Column) -> Column:
    return F.when(top > 0, clamp01(col / top)).otherwise(0.0)


def percent(col: Column) -> Column:
    """0-100 with one decimal, halves away from zero."""
    return F.round(col * 100 * 10) / 10


def age_hours(published: Column, now: Column) -> Column:
    """Fractional hours between two timestamps, null for an unknown date."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 3.6e9


def engagement_raw() -> Column:
    known = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return F.log1p(known("likes") + 2 * known("comments") + 3 * known("shares") + 0.01 * known("views"))


def velocity_raw(engagement: Column, now: Column) -> Column:
    """Engagement per hour of age; an unknown date counts as 720 hours, anything newer than an hour as one."""
    age = F.greatest(F.lit(1.0), age_hours(F.col("published_at"), now))
    return engagement / F.when(F.col("published_at").isNull(), 720.0).otherwise(age)


def recency(now: Column) -> Column:
    age = F.greatest(F.lit(0.0), age_hours(F.col("published_at"), now))
    return F.when(F.col("published_at").isNull(), 0.35).otherwise(F.exp(-age / 336.0))


def prepared(df: DataFrame, query: Column) -> DataFrame:
    """Text columns the text scores read, each computed once per row: _title, _hay, _said, _words, _wanted."""
    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.withColumns({
        "_title": F.lower(known("title")), "_said": F.lower(strip(known("search_source"))),
        "_words": text.tokens(query), "_wanted": F.lower(strip(query)),
        "_author": F.lower(known("author")), "_source": F.lower(known("search_source")),
    }).withColumns({"_hay": F.concat_ws(" ", "_title", "_author", "_source"), "_text": F.concat_ws(" ", "_title", "_source")})


def relevance() -> Column:
    """Share of query words found; at least 0.75 for an expanded phrase; 1 when the title has the query."""
    found = F.filter("_words", lambda w: F.contains(F.col("_hay"), w))
    share = F.size(found) / F.size("_words").cast("double")
    other_phrase = (F.col("_said") != "") & (F.col("_said") != F.col("_wanted"))
    score = F.when(other_phrase, F.greatest(share, F.lit(0.75))).otherwise(share)
    score = F.when(F.contains("_title", "_wanted"), 1.0).otherwise(score)
    return F.when(F.size("_words") == 0, 0.5).otherwise(clamp01(score))


def commerce(weights: dict[str, float] | None = None, terms: list[str] | None = None) -> Column:
    """Platform fit, buying-intent terms and duration fit."""
    name = F.lower(strip(F.coalesce(F.col("platform"), F.lit(""))))
    fit = F.lit(rules.UNKNOWN_PLATFORM_WEIGHT)
    for key, weight in (weights or rules.PLATFORM_WEIGHTS).items():
        fit = F.when(name == key, weight).otherwise(fit)
    hits = F.lit(0)
    for term in terms or rules.INTENT_TERMS:
        hits = hits + F.contains("_text", F.lit(term)).cast("int")
    intent = F.when(hits == 0, 0.35).otherwise(F.least(F.lit(1.0), 0.25 * hits))
    seconds = F.coalesce(F.col("duration_sec"), F.lit(0))
    duration = F.lit(rules.DURATION_FIT_LONG)
    for bound, value in reversed(rules.DURATION_FIT):
        duration = F.when(seconds <= bound, value).otherwise(duration)
    duration = F.when(seconds <= 0, rules.DURATION_FIT_UNKNOWN).otherwise(duration)
    return clamp01(0.55 * fit + 0.30 * intent + 0.15 * duration)
