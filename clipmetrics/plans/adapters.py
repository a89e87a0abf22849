"""Canonical tables derived from the driver's tables, each with the same table as SQL.

All rows and whole texts are used; derived columns only rename or compute, they never select.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics.functions import regions

NOW_SQL = "timestamp '2024-01-31 00:00:00'"


def now() -> Column:
    return F.expr("timestamp'2024-01-31 00:00:00'")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def platform_of(expr: str) -> str:
    return f"case {expr} % 5 when 0 then 'douyin' when 1 then 'weibo' when 2 then 'xigua' when 3 then 'bilibili' else 'other' end"


_DOC_HITS = f"""
select doc_id * 2 as seq, cast(doc_id as {{str}}) as video_id, {platform_of('doc_id')} as platform, text as title,
  source as author, concat('https://clips.example.com/v/', doc_id) as url, cast(null as {{str}}) as thumbnail,
  cast(null as {{str}}) as media_type, cast(null as {{str}}) as download_url, lang as search_source,
  nullif(n_chars % 400, 0) as duration_sec, cast(null as bigint) as views, cast(null as bigint) as likes,
  cast(null as bigint) as comments, cast(null as bigint) as shares, cast(null as {{ntz}}) as published_at
from documents"""
_EVENT_HITS = f"""
select event_id * 2 + 1 as seq, cast(user_id as {{str}}) as video_id, {platform_of('user_id')} as platform,
  cast(null as {{str}}) as title, cast(null as {{str}}) as author, cast(null as {{str}}) as url,
  concat('https://img.example.com/', event_id, '.jpg') as thumbnail, case when event_id % 6 = 0 then 'image' else 'video' end as media_type,
  cast(null as {{str}}) as download_url, event_type as search_source, nullif(event_id % 400, 0) as duration_sec,
  cast(floor(value * 100) as bigint) as views, cast(floor(value * 10) as bigint) as likes, event_id % 50 as comments,
  event_id % 20 as shares, ts as published_at
from events"""
_DUCK = {"str": "varchar", "ntz": "timestamp"}
_SPARK = {"str": "string", "ntz": "timestamp_ntz"}

HITS = f"doc_hits as ({_DOC_HITS}), event_hits as ({_EVENT_HITS}), hits as (select * from doc_hits union all select * from event_hits)".format(**_DUCK)


def _sql(spark: SparkSession, sf_dir: str, text: str, **views: str) -> DataFrame:
    frames = {alias: table(spark, sf_dir, name) for alias, name in views.items()}
    for alias in views:
        text = text.replace(f"from {alias}", f"from {{{alias}}}")
    return spark.sql(text, **frames)


def document_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _DOC_HITS.format(**_SPARK), documents="documents")


def event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _EVENT_HITS.format(**_SPARK), events="events")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of two sources: documents bring texts, events bring counters and dates of the same videos."""
    return document_hits(spark, sf_dir).unionByName(event_hits(spark, sf_dir))


OBSERVATIONS = """observations as (
select cast(user_id as varchar) as video_id, event_id as ord, epoch_us(ts) / 1e6 as t, event_type as text, value / 499.0 as confidence,
  (event_id % 80) / 100.0 as x, (event_id % 70) / 100.0 as y, 0.05 + (event_id % 15) / 100.0 as w, 0.03 + (event_id % 5) / 100.0 as h
from events)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log as timed texts: seconds, event type as text, value as confidence, boxes from the id.

    Values have two decimals; the odd divisor keeps means of confidences off exact rounding ties, where
    engines may differ in the last digit.
    """
    e, at = table(spark, sf_dir, "events"), F.col("event_id")
    share = lambda n: (at % n) / 100.0
    return e.select(
        F.col("user_id").cast("string").alias("video_id"), at.alias("ord"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_type").alias("text"),
        (F.col("value") / 499.0).alias("confidence"), share(80).alias("x"), share(70).alias("y"),
        (0.05 + share(15)).alias("w"), (0.03 + share(5)).alias("h"),
    )


def with_boxes(df: DataFrame) -> DataFrame:
    return df.withColumn("boxes", F.array(regions.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))))


CUES = """cues as (
select conv_id as video_id, turn as ord, turn * 3.0::double as start_s, turn * 3.0::double + 1.0 + (length(text) % 40) / 10.0 as end_s, text
from conversations)"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a video, a turn a subtitle line."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 3.0
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("ord"), start.alias("start_s"),
                    (start + 1.0 + (F.length("text") % 40) / 10.0).alias("end_s"), "text")


SEGMENTS = """segments as (
select conv_id as video_id, turn as seg_id, turn * 5.0::double + (length(text) % 7) * 0.5 as start_s,
  turn * 5.0::double + (length(text) % 7) * 0.5 + 0.8 as end_s, (conv_id % 50) / 100.0 as x, (turn % 9) / 10.0 as y, 0.30::double as w, 0.08::double as h
from conversations)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment per turn on a slower clock, so cues overlap them, nearly miss them or find none."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 5.0 + (F.length("text") % 7) * 0.5
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("seg_id"), start.alias("start_s"), (start + 0.8).alias("end_s"),
                    ((F.col("conv_id") % 50) / 100.0).alias("x"), ((F.col("turn") % 9) / 10.0).alias("y"), F.lit(0.30).alias("w"), F.lit(0.08).alias("h"))


_STREAMS = """
select l_orderkey as video_id, l_linenumber as idx,
  case when l_returnflag = 'A' then 'audio/mp4' else 'video/mp4' end as mime,
  cast(floor(l_extendedprice) as bigint) as bandwidth, 0 as width,
  case when l_returnflag = 'R' then 0 else cast(l_quantity as int) * 40 end as height
from lineitem"""
STREAMS = f"streams as ({_STREAMS})"


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a video, a line one of its streams."""
    return _sql(spark, sf_dir, _STREAMS, lineitem="lineitem")


_JOB_EVENTS = """
select o_custkey as job_id, o_orderkey as seq, o_orderdate as ts,
  case o_orderkey % 8 when 0 then 'queued' when 1 then 'downloading' when 2 then 'localizing' when 3 then 'rendering'
    when 4 then 'aspect_rendering' when 5 then 'done' when 6 then 'failed' else 'localization_failed' end as status,
  cast(o_orderkey % 3 as int) as attempts,
  case when o_orderkey % 8 in (6, 7) then concat('stage failed: ', o_orderpriority) end as error
from orders"""
JOB_EVENTS = f"job_events as ({_JOB_EVENTS})"
JOBS = (JOB_EVENTS + ", jobs as (select job_id, max(seq) as seq, arg_max(ts, seq) as ts, arg_max(status, seq) as status, "
        "arg_max(attempts, seq) as attempts, first(error order by seq desc) as error from job_events group by job_id)")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a job, an order one of its log rows."""
    return _sql(spark, sf_dir, _JOB_EVENTS, orders="orders")


_HISTORY = f"""
select concat('j', o_orderkey) as job_id, o_orderkey as seq,
  case when o_orderkey % 7 = 0 then concat(' ', upper({platform_of('o_custkey')})) else {platform_of('o_custkey')} end as platform,
  case when o_orderkey % 3 = 0 then '' else cast(o_custkey as {{str}}) end as video_id,
  concat('https://clips.example.com/v/', o_custkey) as url,
  case o_orderkey % 8 when 0 then 'queued' when 1 then 'downloading' when 2 then 'localizing' when 3 then 'rendering'
    when 4 then 'aspect_rendering' when 5 then 'done' when 6 then 'failed' else 'localization_failed' end as status
from orders"""
HISTORY = f"history as ({_HISTORY})".format(**_DUCK)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with the video they were started for; some know only its address."""
    return _sql(spark, sf_dir, _HISTORY.format(**_SPARK), orders="orders")


_PAIRS = """
select a.doc_id as id, a.text as source_text, case when a.doc_id % 5 = 0 then a.text else coalesce(b.text, '') end as target_text
from documents a left join documents b on b.doc_id = a.doc_id + 1"""
PAIRS = f"pairs as ({_PAIRS})"
PAIR_SCRIPT = "[à-ÿ]"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text pairs by id, the last with an empty target; every fifth target is a copy of its source."""
    d = table(spark, sf_dir, "documents")
    nxt = d.select((F.col("doc_id") - 1).alias("id"), F.col("text").alias("next_text"))
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("source_text")).join(nxt, "id", "left").select(
        "id", "source_text", F.when(F.col("id") % 5 == 0, F.col("source_text")).otherwise(F.coalesce("next_text", F.lit(""))).alias("target_text"))
