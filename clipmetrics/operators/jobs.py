"""Job history: event log to current jobs, transitions, history matching, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmetrics import rules
from clipmetrics.functions.text import strip


def current_jobs(events: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """Last event per job wins. A partial aggregate, so a job with very many events is no hot spot."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_job")).select(key, "_job.*")


def upsert(jobs: DataFrame, changes: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """Changed rows replace stored ones; new rows are added."""
    return current_jobs(jobs.unionByName(changes), key, order)


def _touched(jobs: DataFrame, changed: Column, now: Column | None) -> dict[str, Column]:
    """updated_at of the rows that change, where the table and the caller know the time."""
    known = now is not None and "updated_at" in jobs.columns
    return {"updated_at": F.when(changed, now).otherwise(F.col("updated_at"))} if known else {}


def resume(jobs: DataFrame, now: Column | None = None) -> DataFrame:
    """State after a restart: interrupted work is queued again, an interrupted aspect export is done with a note.

    Processing mode and output aspect, where the table has them, are normalised for every job.
    """
    queued, aspect = F.col("status").isin(rules.RESUMABLE), F.col("status") == "aspect_rendering"
    settings = {"mode": normalized_mode, "aspect": normalized_aspect}
    return jobs.withColumns({
        **{c: normalise(F.col(c)) for c, normalise in settings.items() if c in jobs.columns},
        **_touched(jobs, F.coalesce(queued | aspect, F.lit(False)), now),
        "attempts": F.when(F.col("attempts") <= 0, 1).otherwise(F.col("attempts")),
        "resumed": queued,
        "error": F.when(aspect, rules.INTERRUPTED).otherwise(F.col("error")),
        "status": F.when(queued, "queued").when(aspect, "done").otherwise(F.col("status")),
    })


def retry(jobs: DataFrame, now: Column | None = None) -> DataFrame:
    """Failed jobs start over; others keep their state and carry the reason of the refusal."""
    running, done = F.col("status").isin(rules.RUNNING), F.col("status") == "done"
    rejected = F.when(running, "job is already running").when(done, "job is already complete")
    ok = rejected.isNull()
    changes = {
        **_touched(jobs, ok, now),
        "rejected": rejected,
        "attempts": F.when(ok, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "error": F.when(ok, F.lit(None).cast("string")).otherwise(F.col("error")),
        "status": F.when(ok, "queued").otherwise(F.col("status")),
    }
    if "localization" in jobs.columns:
        changes["localization"] = F.when(~ok, F.col("localization"))
    return jobs.withColumns(changes)


def is_running(status: Column) -> Column:
    return status.isin(rules.RUNNING)


def editable(jobs: DataFrame) -> DataFrame:
    """Jobs whose subtitles may be edited."""
    return jobs.where(~is_running(F.col("status")))


def delete(jobs: DataFrame, keys: DataFrame, key: str = "job_id") -> DataFrame:
    return jobs.join(keys.select(key), key, "left_anti")


def keep_previous(current: DataFrame, rerendered: DataFrame) -> DataFrame:
    """rerendered(job_id, ok, output, error) over current(job_id, status, output, error).

    A failed re-render of a completed job keeps the earlier output with a note, any other failure fails the job.
    """
    fresh = rerendered.select("job_id", "ok", F.col("output").alias("n_output"), F.col("error").alias("n_error"))
    both = current.join(fresh, "job_id", "left")
    had = (F.col("status") == "done") & F.col("output").isNotNull()
    failed = ~F.coalesce(F.col("ok"), F.lit(True))
    note = F.concat(F.lit("rerender failed; previous completed output kept: "), F.col("n_error"))
    return both.select(
        "job_id",
        F.when(failed & ~had, "localization_failed").when(F.col("ok"), "done").otherwise(F.col("status")).alias("status"),
        F.when(F.col("ok"), F.col("n_output")).otherwise(F.col("output")).alias("output"),
        F.when(failed & had, note).when(failed, F.col("n_error")).when(F.col("ok"), F.lit(None)).otherwise(F.col("error")).alias("error"),
    )


def revisions(edits: DataFrame) -> DataFrame:
    """Subtitle revision per job: number of saved edits."""
    return edits.groupBy("job_id").agg(F.count(F.lit(1)).alias("subtitle_revision"))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


def stage_report(jobs: DataFrame, approximate: bool = True) -> DataFrame:
    """jobs(timings map, cache_hits array): seconds per stage and share of jobs that hit the stage's cache.

    The exact median keeps every distinct value of a stage in one buffer; the default sketch does not.
    """
    per_stage = jobs.select(
        F.explode("timings").alias("stage", "seconds"), F.col("cache_hits"),
    ).withColumn("hit", F.array_contains("cache_hits", F.col("stage")).cast("int"))
    median = F.percentile_approx("seconds", 0.5, 10000) if approximate else F.percentile("seconds", 0.5)
    return per_stage.groupBy("stage").agg(
        F.count(F.lit(1)).alias("jobs"), F.avg("seconds").alias("avg_seconds"), median.alias("median_seconds"),
        F.max("seconds").alias("max_seconds"), F.avg("hit").alias("cache_hit_rate"),
    )


def history_state(status: Column) -> Column:
    return (
        F.when(status.isNull(), "not_downloaded").when(status.isin(rules.RUNNING), "in_progress").when(status == "done", "done")
        .when(status == "localization_failed", "done_processing_failed").otherwise("failed")
    )


def with_history(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Candidate state from jobs(platform, video_id, url, status, seq): by platform and id, else by address.

    Platforms are compared trimmed and in lower case, as when candidates are merged. A blank id or address gets a key of its own that matches nothing, so blanks spread over all partitions.
    """
    ident, link = (strip(F.coalesce(F.col(c), F.lit(""))) for c in ("video_id", "url"))
    platform = F.lower(strip(F.coalesce(F.col("platform"), F.lit("")))).alias("_platform")
    by_id = jobs.where(ident != "").groupBy(platform, ident.alias("_id")).agg(F.max_by("status", "seq").alias("_by_id"))
    by_url = jobs.where(link != "").groupBy(link.alias("_url")).agg(F.max_by("status", "seq").alias("_by_url"))
    no_id, no_link = F.concat(F.lit("# "), link), F.concat(F.lit("# "), ident)
    keyed = candidates.withColumns({
        "_platform": platform, "_id": F.when(ident != "", ident).otherwise(no_id), "_url": F.when(link != "", link).otherwise(no_link),
    })
    joined = keyed.join(by_id, ["_platform", "_id"], "left").join(by_url, "_url", "left")
    state = history_state(F.coalesce("_by_id", "_by_url"))
    return joined.withColumn("history", state).drop("_platform", "_id", "_url", "_by_id", "_by_url")


def unseen(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Candidates that history neither has downloaded, with or without a processing failure, nor is working on."""
    return with_history(candidates, jobs).where(F.col("history").isin("not_downloaded", "failed")).drop("history")


def normalized_mode(col: Column) -> Column:
    name = F.lower(strip(F.coalesce(col, F.lit(""))))
    return F.when(name.isin(rules.MODES), name).otherwise("dub")


def normalized_aspect(col: Column) -> Column:
    name = F.lower(strip(F.coalesce(col, F.lit(""))))
    return F.when(name.isin(rules.ASPECTS), name).otherwise("original")


def search_mode(col: Column) -> Column:
    name = F.lower(strip(F.coalesce(col, F.lit(""))))
    return F.when(name.isin(rules.CHANNEL_MODES), "channel").otherwise("keyword")


def render_style(col: Column) -> Column:
    """Style by alias, null when unknown."""
    name = F.lower(strip(F.coalesce(col, F.lit(""))))
    style = F.lit(None).cast("string")
    for alias, value in rules.STYLES.items():
        style = F.when(name == alias, value).otherwise(style)
    return style


def validate_settings(requests: DataFrame) -> DataFrame:
    """requests(mode, aspect, style) normalised; invalid names a rejected setting, null when all are fine."""
    name = lambda c: F.lower(strip(F.coalesce(F.col(c), F.lit(""))))
    bad_mode = (name("mode") != "") & ~name("mode").isin(rules.MODES)
    bad_aspect = (name("aspect") != "") & ~name("aspect").isin(rules.ASPECTS)
    style = render_style(F.col("style"))
    invalid = F.when(bad_mode, "mode").when(bad_aspect, "aspect").when(style.isNull(), "style")
    return requests.withColumns({
        "invalid": invalid, "mode": normalized_mode(F.col("mode")), "aspect": normalized_aspect(F.col("aspect")), "style": style,
    })


def merge_outputs(outputs: Column, fresh: Column) -> Column:
    """Outputs per aspect with blank paths removed; a newer path replaces the older one."""
    kept = F.map_filter(F.coalesce(outputs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))),
                        lambda k, v: ~F.map_contains_key(fresh, k))
    return F.map_filter(F.map_concat(kept, fresh), lambda k, v: strip(v) != "")
