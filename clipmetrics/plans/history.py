"""Job-history queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics import rules
from clipmetrics.operators import jobs, ranking
from clipmetrics.plans.adapters import HISTORY, JOB_EVENTS, JOBS, NOW_SQL, history, job_events, now, table
from clipmetrics.plans.discovery import MERGED, SCORED, _scored, merged
from clipmetrics.sources import jobs as store

JOB_COLUMNS = ["job_id", "seq", "ts", "status", "attempts", "error"]


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.current_jobs(job_events(spark, sf_dir))


def job_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select(*JOB_COLUMNS)


def job_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.newest_first(_jobs(spark, sf_dir), "ts").select("job_id", "ts", "status")


def job_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of the first two priorities as the stored table, the rest as changes to it."""
    log = job_events(spark, sf_dir)
    stored, changes = log.where("error is not null"), log.where("error is null")
    return jobs.upsert(jobs.current_jobs(stored), changes).select(*JOB_COLUMNS)


def job_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored jobs name their mode and aspect in odd spellings."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("job_id") % len(values) + 1).cast("int"))
    stored = _jobs(spark, sf_dir).withColumns({
        "mode": pick([" Dub", "", "OCR_MUSIC ", "karaoke"]), "aspect": pick(["", " 9:16", "Original", "4:3", "1:1"]), "updated_at": F.col("ts").cast("timestamp")})
    return jobs.resume(stored, now()).select(
        "job_id", "status", "attempts", "error", "resumed", "mode", "aspect", F.unix_seconds("updated_at").alias("updated_s"))


def job_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.retry(_jobs(spark, sf_dir)).select("job_id", "status", "attempts", "error", "rejected")


def job_editable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.editable(_jobs(spark, sf_dir)).select("job_id", "status")


def job_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of customers that have a failed row are removed."""
    log = job_events(spark, sf_dir)
    return jobs.delete(_jobs(spark, sf_dir), log.where("status = 'failed'")).select(*JOB_COLUMNS)


def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.status_counts(_jobs(spark, sf_dir))


def job_stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a job run: its line's quantities are the seconds of its stages."""
    lines = table(spark, sf_dir, "lineitem")
    stage = F.element_at(F.array(*[F.lit(s) for s in ("download", "ocr", "translate", "tts", "render", "aspect", "publish")]), F.col("l_linenumber"))
    runs = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("s"), F.max("l_returnflag").alias("f")).select(
        F.create_map(stage, F.col("s")).alias("timings"), F.when(F.col("f") == "R", F.array(stage)).otherwise(F.array().cast("array<string>")).alias("cache_hits"))
    out = jobs.stage_report(runs, approximate=False)  # seven stages of small whole numbers: few distinct values to keep
    return out.withColumns({c: F.round(c, 6) for c in ("avg_seconds", "cache_hit_rate")})


def job_history_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.with_history(merged(spark, sf_dir), history(spark, sf_dir)).select("seq", "platform", "video_id", "history")


def job_topn_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(jobs.unseen(_scored(spark, sf_dir), history(spark, sf_dir)), "overall", 10).select("seq", "platform", "video_id", "overall")


def job_rerender_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = _jobs(spark, sf_dir).select("job_id", "status", F.when(F.col("seq") % 5 != 0, F.concat(F.lit("out/"), "job_id")).alias("output"), "error")
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), (F.col("c_custkey") % 2 == 0).alias("ok"),
                                                   F.concat(F.lit("new/"), "c_custkey").alias("output"), F.concat(F.lit("exit "), F.col("c_custkey") % 7).alias("error"))
    return jobs.keep_previous(current, runs)


def job_subtitle_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.revisions(job_events(spark, sf_dir))


def job_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part attributes as request settings: modes, aspects and styles in odd spellings, some invalid."""
    p = table(spark, sf_dir, "part")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by + 1).cast("int"))
    requests = p.select(
        "p_partkey", pick([" Dub", "", "OCR_MUSIC ", "subtitles", "karaoke"], F.col("p_partkey") % 5).alias("mode"),
        pick(["", " 9:16", "Original", "4:3"], F.col("p_size") % 4).alias("aspect"), pick(["", "OCR_Box", "capsule ", "neon"], F.length("p_name") % 4).alias("style"),
        pick(["creator", "", " Channel", "keyword", "tags"], F.col("p_size") % 5).alias("kind"),
    )
    return jobs.validate_settings(requests).withColumn("kind", jobs.search_mode(F.col("kind")))


def job_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs encoded to stored rows, written by an older version without revision column, decoded again."""
    typed = _jobs(spark, sf_dir).select(
        F.col("job_id").cast("string").alias("job_id"), "status",
        F.struct(F.concat(F.lit("v"), "job_id").alias("id"), F.lit("weibo").alias("platform"), F.col("error").alias("title"), F.lit(None).cast("string").alias("url"), F.col("seq").alias("likes")).alias("video"),
        F.lit("dub").alias("mode"), F.lit("9:16").alias("aspect"), F.create_map(F.lit("9:16"), F.concat(F.lit("out/"), "job_id")).alias("outputs"), "attempts", F.lit(3).alias("subtitle_revision"),
        F.struct(F.lit("zh").alias("detectedLanguage"), F.col("attempts").alias("segments"), F.lit(None).cast("string").alias("skippedReason"),
                 F.create_map(F.lit("ocr"), F.col("seq") / 4.0).alias("timings"), F.array(F.lit("ocr")).alias("cacheHits")).alias("localization"),
        "error", F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("updated_at"),
    )
    back = store.decode_jobs(store.encode_jobs(typed).drop("subtitle_revision"))
    return back.select("job_id", "status", F.col("video.id").alias("video"), F.col("video.likes").alias("likes"), F.col("outputs")["9:16"].alias("output"), "attempts", "subtitle_revision",
                       F.col("localization.timings")["ocr"].alias("ocr_s"), F.array_join("localization.cacheHits", ",").alias("hits"), "error", F.unix_seconds("created_at").alias("created_s"))


def job_outputs_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = F.create_map(F.lit("9:16"), F.concat(F.lit("a/"), "o_orderkey"), F.lit("1:1"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise("b"))
    new = F.create_map(F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("9:16"), F.concat(F.lit("n/"), "o_orderkey"))
    rows = o.select("o_orderkey", jobs.merge_outputs(old, new).alias("m"))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e.key, F.lit("="), e.value))), ";")
    return rows.select("o_orderkey", text.alias("outputs"))


RESUMABLE = ", ".join(f"'{s}'" for s in rules.RESUMABLE)
RUNNING = ", ".join(f"'{s}'" for s in rules.RUNNING)

QUERIES = {
    "job_latest": (job_latest, f"with {JOBS} select job_id, seq, ts, status, attempts, error from jobs"),
    "job_newest_first": (job_newest_first, f"with {JOBS} select job_id, ts, status from jobs"),
    "job_upsert": (job_upsert, f"with {JOBS} select job_id, seq, ts, status, attempts, error from jobs"),
    "job_resume": (job_resume, f"""with {JOBS} select job_id, case when status in ({RESUMABLE}) then 'queued' when status = 'aspect_rendering' then 'done' else status end as status,
case when attempts <= 0 then 1 else attempts end as attempts, case when status = 'aspect_rendering' then '{rules.INTERRUPTED}' else error end as error, status in ({RESUMABLE}) as resumed,
['dub', 'dub', 'ocr_music', 'dub'][job_id % 4 + 1] as mode, ['original', '9:16', 'original', 'original', '1:1'][job_id % 5 + 1] as aspect,
case when status in ({RUNNING}) then epoch({NOW_SQL})::bigint else epoch_us(ts) // 1000000 end as updated_s from jobs"""),
    "job_retry": (job_retry, f"""with {JOBS}, r as (select *, case when status in ({RUNNING}) then 'job is already running' when status = 'done' then 'job is already complete' end as rejected from jobs)
select job_id, case when rejected is null then 'queued' else status end as status, case when rejected is null then attempts + 1 else attempts end as attempts, case when rejected is not null then error end as error, rejected from r"""),
    "job_editable": (job_editable, f"with {JOBS} select job_id, status from jobs where status not in ({RUNNING})"),
    "job_delete": (job_delete, f"with {JOBS} select job_id, seq, ts, status, attempts, error from jobs where job_id not in (select job_id from job_events where status = 'failed')"),
    "job_status_counts": (job_status_counts, f"with {JOBS} select status, count(*) as jobs from jobs group by status"),
    "job_stage_report": (job_stage_report, """with r as (select l_orderkey, l_linenumber, max(l_quantity) as s, max(l_returnflag) as f from lineitem group by all),
n as (select ['download', 'ocr', 'translate', 'tts', 'render', 'aspect', 'publish'][l_linenumber] as stage, s, (f = 'R')::int as hit from r)
select stage, count(*) as jobs, round(avg(s), 6) as avg_seconds, quantile_cont(s, 0.5) as median_seconds, max(s) as max_seconds, round(avg(hit), 6) as cache_hit_rate from n group by stage"""),
    "job_history_join": (job_history_join, f"""with {MERGED}, {HISTORY},
by_id as (select lower(trim(platform)) as platform, video_id, arg_max(status, seq) as s from history where video_id <> '' group by all), by_url as (select url, arg_max(status, seq) as s from history group by url),
st as (select m.seq, m.platform, m.video_id, coalesce(i.s, u.s) as s from merged m left join by_id i on i.platform = lower(trim(m.platform)) and i.video_id = m.video_id left join by_url u on u.url = m.url)
select seq, platform, video_id, case when s is null then 'not_downloaded' when s in ({RUNNING}) then 'in_progress' when s = 'done' then 'done' when s = 'localization_failed' then 'done_processing_failed' else 'failed' end as history from st"""),
    "job_topn_unseen": (job_topn_unseen, f"""with {SCORED}, {HISTORY},
last_id as (select lower(trim(platform)) as p, video_id as v, status, row_number() over (partition by lower(trim(platform)), video_id order by seq desc) as k from history where video_id <> ''),
last_url as (select url as u, status, row_number() over (partition by url order by seq desc) as k from history where url <> '')
select seq, platform, video_id, overall from scored s left join last_id i on i.k = 1 and i.p = lower(trim(s.platform)) and i.v = s.video_id left join last_url u on u.k = 1 and u.u = s.url
where coalesce(i.status, u.status, 'none') not in ({RUNNING}, 'done', 'localization_failed') order by overall desc, seq limit 10"""),
    "job_rerender_fallback": (job_rerender_fallback, f"""with {JOBS}, cur as (select job_id, status, case when seq % 5 <> 0 then 'out/' || job_id end as output, error from jobs),
b as (select cur.*, c_custkey % 2 = 0 as ok, 'new/' || c_custkey as n_output, 'exit ' || (c_custkey % 7) as n_error, status = 'done' and output is not null as had from cur left join customer on c_custkey = job_id)
select job_id, case when not ok and not had then 'localization_failed' when ok then 'done' else status end as status, case when ok then n_output else output end as output,
case when not ok and had then 'rerender failed; previous completed output kept: ' || n_error when not ok then n_error when ok then null else error end as error from b"""),
    "job_subtitle_revisions": (job_subtitle_revisions, f"with {JOB_EVENTS} select job_id, count(*) as subtitle_revision from job_events group by job_id"),
    "job_settings": (job_settings, """with r as (select p_partkey, [' Dub', '', 'OCR_MUSIC ', 'subtitles', 'karaoke'][p_partkey % 5 + 1] as mode, ['', ' 9:16', 'Original', '4:3'][p_size % 4 + 1] as aspect,
['', 'OCR_Box', 'capsule ', 'neon'][length(p_name) % 4 + 1] as style, ['creator', '', ' Channel', 'keyword', 'tags'][p_size % 5 + 1] as kind from part)
select p_partkey, case mode when ' Dub' then 'dub' when 'OCR_MUSIC ' then 'ocr_music' when 'subtitles' then 'subtitles' else 'dub' end as mode, case aspect when ' 9:16' then '9:16' else 'original' end as aspect,
case style when '' then 'clean' when 'OCR_Box' then 'box' when 'capsule ' then 'capsule' end as style, case when lower(trim(kind)) in ('creator', 'channel') then 'channel' else 'keyword' end as kind,
case when mode = 'karaoke' then 'mode' when aspect = '4:3' then 'aspect' when style = 'neon' then 'style' end as invalid from r"""),
    "job_store_roundtrip": (job_store_roundtrip, f"""with {JOBS} select cast(job_id as varchar) as job_id, status, 'v' || job_id as video, seq as likes, 'out/' || job_id as output, attempts, 0 as subtitle_revision, seq / 4.0 as ocr_s, 'ocr' as hits, error,
epoch_us(ts) // 1000000 as created_s from jobs"""),
    "job_outputs_merge": (job_outputs_merge, """select o_orderkey, array_to_string(list_sort(list_filter([o_orderstatus || '=' || o_orderpriority, '9:16=n/' || o_orderkey, case when o_orderkey % 2 <> 0 then '1:1=b' end], lambda x: x is not null)), ';') as outputs from orders"""),
}
