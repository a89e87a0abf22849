"""Streaming queries: the driver's tables read as file streams and run until everything is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics import rules
from clipmetrics.operators import captions as batch_captions
from clipmetrics.operators.jobs import current_jobs
from clipmetrics.plans.adapters import HITS, OBSERVATIONS, now, platform_of
from clipmetrics.plans.captions import HOURLY, islands
from clipmetrics.plans.discovery import FLAT, QUERY, SCORE_COLUMNS, merged_sql, quoted, score_sql
from clipmetrics.streaming import candidates, captions, runs, state, tables

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.read_stream(spark, sf_dir, EVENTS, "events.parquet")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    none = F.lit(None).cast("string")
    return e.select(
        (F.col("event_id") * 2 + 1).alias("seq"), F.col("user_id").cast("string").alias("video_id"), F.expr(platform_of("user_id")).alias("platform"),
        none.alias("title"), none.alias("author"), none.alias("url"), F.concat(F.lit("https://img.example.com/"), F.col("event_id"), F.lit(".jpg")).alias("thumbnail"),
        F.when(F.col("event_id") % 6 == 0, "image").otherwise("video").alias("media_type"), none.alias("download_url"), F.col("event_type").alias("search_source"),
        F.nullif(F.col("event_id") % 400, F.lit(0).cast("bigint")).alias("duration_sec"), F.floor(F.col("value") * 100).alias("views"), F.floor(F.col("value") * 10).alias("likes"),
        (F.col("event_id") % 50).alias("comments"), (F.col("event_id") % 20).alias("shares"), F.col("ts").cast("timestamp").alias("published_at"),
    )


def st_candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = runs.changes_available(candidates.merge_stream(_hits(spark, sf_dir)), "merge")
    return candidates.merged(spark, log).select(*[c for c in FLAT if c != "published_at"], F.unix_micros("published_at").alias("published_us"))


def st_repeat_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = candidates.suppress_repeats(_hits(spark, sf_dir), "published_at", "40 days", ["platform", "video_id", "search_source"])
    return spark.read.parquet(runs.append_available(first.select("platform", "video_id", "search_source"), "repeats"))


def _windows(df: DataFrame) -> DataFrame:
    return df.select(F.unix_seconds("window_start").alias("start_s"), F.unix_seconds("window_end").alias("end_s"), "platform", "hits", "likes", "views", F.round("top_engagement", 6).alias("top_engagement"))


def st_trend_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.append_available(candidates.trend_windows(_hits(spark, sf_dir), "published_at", "1 hour"), "windows")
    return _windows(spark.read.parquet(rows))


def st_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.append_available(candidates.trend_windows(_hits(spark, sf_dir), "published_at", "1 hour", "1 day", "6 hours"), "sliding")
    return _windows(spark.read.parquet(rows))


def st_caption_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    obs = e.select(F.col("user_id").cast("string").alias("video_id"), F.col("event_type").alias("text"), (F.col("value") / 499.0).alias("confidence"), F.col("ts").cast("timestamp").alias("at"))
    rows = spark.read.parquet(runs.append_available(captions.caption_sessions(obs, "at", "1 day", "1 hour"), "sessions"))
    return rows.select("video_id", "text", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "observation_count", F.round("confidence", 6).alias("confidence"))


def st_caption_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    obs = _events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("ord"), (F.unix_micros(at) / 1e6).alias("t"),
        F.col("event_type").alias("text"), (F.col("value") / 499.0).alias("confidence"), at.alias("at"))
    accepted = batch_captions.accept(obs, HOURLY)
    rows = spark.read.parquet(runs.append_available(captions.segment_stream(accepted, "at", "1 hour", HOURLY), "segments"))
    return rows.withColumn("confidence", F.round("confidence", 6))


def st_candidate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = tables.table_available(candidates.merge_parts(_hits(spark, sf_dir)), "candidates", candidates.merge_of_parts)
    rows = candidates.from_parts(table.read(spark))
    return rows.select(*[c for c in FLAT if c != "published_at"], F.unix_micros("published_at").alias("published_us"))


def st_job_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a job, an order its state from then on."""
    o = runs.read_stream(spark, sf_dir, ORDERS, "orders.parquet")
    changes = o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("status"), F.col("o_totalprice").alias("size"))
    table = tables.table_available(changes, "jobs", current_jobs)
    return table.read(spark).drop("batch")


def st_top_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = tables.TopSnapshot(runs.work_dir(spark, "top"), candidates.MERGE_KEYS, F.lit(QUERY), now())
    newest = tables.newest(candidates.MERGE_KEYS, "batch")
    table = tables.table_available(candidates.merge_stream(_hits(spark, sf_dir)), "merged", newest, then=top.update)
    return top.read(spark, table.batches(spark) - 1).select(*SCORE_COLUMNS)


def st_preview_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    at = F.col("ts").cast("timestamp")
    requests = e.select(F.col("user_id").cast("string").alias("key"), F.unix_micros(at).alias("at_us"), F.col("event_id").alias("request"), (F.col("event_type") != "error").alias("found"), at.alias("at"))
    return spark.read.parquet(runs.append_available(state.preview_cache(requests, "at", "1 hour"), "cache"))


def st_job_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = runs.read_stream(spark, sf_dir, ORDERS, "orders.parquet")
    at = F.col("o_orderdate").cast("timestamp")
    status = F.element_at(F.array(*[F.lit(s) for s in [*rules.RUNNING, "done", *rules.FAILED]]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    events = o.select(F.col("o_custkey").cast("string").alias("job_id"), F.col("o_orderkey").alias("seq"), F.unix_micros(at).alias("at_us"), status.alias("status"), at.alias("at"))
    log = runs.changes_available(state.job_monitor(events, "at", "1 hour"), "monitor")
    # A job's interruption is reported after its last change, and a later change replaces it.
    return runs.latest(spark, log, ["job_id"]).select("job_id", "seq", "status", "attempts", "at_us", "interrupted")


def st_rank_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    writer = candidates.snapshot_writer(F.lit(QUERY), now())
    log = runs.changes_available(candidates.merge_stream(_hits(spark, sf_dir)), "snapshot", then=writer)
    return candidates.newest_snapshot(spark, log).select(*SCORE_COLUMNS)


EVENT_MERGED = f"{HITS}, m as ({merged_sql('event_hits')})"
ENGAGEMENT = "round(max(ln(1 + likes::double + 2 * comments::double + 3 * shares::double + 0.01::double * views)), 6) as top_engagement"
STATUS = "[" + ", ".join(quoted(s) for s in [*rules.RUNNING, "done", *rules.FAILED]) + "][o_orderkey % 8 + 1]"

QUERIES = {
    "st_candidate_merge": (st_candidate_merge, f"with {EVENT_MERGED} select {', '.join(c for c in FLAT if c != 'published_at')}, epoch_us(published_at) as published_us from m"),
    "st_repeat_suppression": (st_repeat_suppression, f"with {HITS} select distinct platform, video_id, search_source from event_hits"),
    "st_trend_windows": (st_trend_windows, f"""with {HITS}, w as (select *, epoch_us(date_trunc('day', published_at)) // 1000000 as start_s from event_hits)
select start_s, start_s + 86400 as end_s, platform, count(*) as hits, cast(sum(likes) as bigint) as likes, cast(sum(views) as bigint) as views, {ENGAGEMENT} from w
where start_s + 86400 <= (select epoch_us(max(published_at)) / 1e6 - 3600 from w) group by start_s, platform"""),
    "st_sliding_windows": (st_sliding_windows, f"""with {HITS}, w as (select *, (epoch_us(published_at) // 1000000 // 21600 - k) * 21600 as start_s from event_hits, (values (0), (1), (2), (3)) as t(k))
select start_s, start_s + 86400 as end_s, platform, count(*) as hits, cast(sum(likes) as bigint) as likes, cast(sum(views) as bigint) as views, {ENGAGEMENT} from w
where start_s + 86400 <= (select epoch_us(max(published_at)) / 1e6 - 3600 from event_hits) group by start_s, platform"""),
    "st_caption_sessions": (st_caption_sessions, """with e as (select cast(user_id as varchar) as video_id, event_type as text, epoch_us(ts) as us, value / 499.0 as confidence from events),
l as (select *, us - lag(us) over (partition by video_id, text order by us) as d from e), s as (select *, sum(case when d is null or d > 86400000000 then 1 else 0 end) over (partition by video_id, text order by us) as n from l),
g as (select video_id, text, min(us) as start_us, max(us) + 86400000000 as end_us, count(*) as observation_count, round(max(confidence), 6) as confidence from s group by video_id, text, n)
select * from g where end_us <= (select max(us) - 3600000000 from e)"""),
    "st_caption_segments": (st_caption_segments, f"""with {OBSERVATIONS}, {islands('observations', 'text', '0.10')},
g as (select video_id, seg_no, min(t) as start_s, max(t) as last_s, arg_min(text, (-confidence, ord)) as text, round(avg(confidence), 6) as confidence, count(*) as observation_count from seg group by all),
n as (select *, lead(start_s) over (partition by video_id order by seg_no) as next_s, (select max(t) - 3600 from acc) as passed from g)
select video_id, start_s, last_s + 3600 as end_s, text, confidence, observation_count from n where next_s <= passed or last_s + 86400 < passed"""),
    "st_candidate_table": (st_candidate_table, f"with {EVENT_MERGED} select {', '.join(c for c in FLAT if c != 'published_at')}, epoch_us(published_at) as published_us from m"),
    "st_job_table": (st_job_table, "select o_custkey as job_id, max(o_orderkey) as seq, arg_max(o_orderpriority, o_orderkey) as status, arg_max(o_totalprice, o_orderkey) as size from orders group by o_custkey"),
    "st_top_snapshot": (st_top_snapshot, f"with {EVENT_MERGED}, {score_sql('m', quoted(QUERY))} select {', '.join(SCORE_COLUMNS)} from scored order by overall desc, seq limit 30"),
    "st_preview_cache": (st_preview_cache, """with recursive r as (select cast(user_id as varchar) as key, epoch_us(ts) as at_us, event_id as request, case when event_type = 'error' then 180000000 else 1800000000 end as ttl, row_number() over (partition by user_id order by ts, event_id) as rn from events),
walk as (select key, at_us, request, rn, 'fetched' as outcome, at_us + ttl as expires_us from r where rn = 1
union all select r.key, r.at_us, r.request, r.rn, case when r.at_us <= w.expires_us then 'cached' else 'fetched' end, case when r.at_us <= w.expires_us then w.expires_us else r.at_us + r.ttl end from walk w join r on r.key = w.key and r.rn = w.rn + 1)
select key, at_us, request, outcome, expires_us from walk"""),
    "st_job_monitor": (st_job_monitor, f"""with e as (select cast(o_custkey as varchar) as job_id, o_orderkey as seq, {STATUS} as status, epoch_us(o_orderdate) as at_us from orders),
j as (select job_id, arg_max(seq, (at_us, seq)) as seq, arg_max(status, (at_us, seq)) as status, count(*) filter (where status = 'queued') as attempts, max(at_us) as at_us from e group by job_id)
select *, status in ({', '.join(quoted(s) for s in rules.RUNNING)}) and at_us + 10800000000 <= (select max(at_us) - 3600000000 from e) as interrupted from j"""),
    "st_rank_snapshot": (st_rank_snapshot, f"with {EVENT_MERGED}, {score_sql('m', quoted(QUERY))} select {', '.join(SCORE_COLUMNS)} from scored order by overall desc, seq limit 30"),
}
