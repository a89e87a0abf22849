"""Stream choice, link lists, rendition planning, deterministic assignment, stage planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmetrics import rules
from clipmetrics.functions.text import strip
from clipmetrics.operators.ordered import dense_ids
from clipmetrics.session import written


def pick_streams(streams: DataFrame, key: str = "video_id") -> DataFrame:
    """Best picture up to 1080 lines (else the smallest), best sound, best combined stream per video.

    Ties go to the earlier stream. One aggregation, combined map-side.
    """
    mime = F.lower(strip("mime"))
    picture = F.startswith(mime, F.lit("video/")) & ((F.coalesce("width", F.lit(0)) > 0) | (F.coalesce("height", F.lit(0)) > 0))
    combined = F.startswith(mime, F.lit("video/")) & ~picture
    sound = F.startswith(mime, F.lit("audio/"))
    early = -F.col("idx")
    best = lambda cond, *order: F.max(F.when(cond, F.struct(*order, early.alias("e"))))
    small = F.min(F.when(F.startswith(mime, F.lit("video/")) & (F.col("height") > 0), F.struct("height", F.col("idx").alias("i"))))
    picked = streams.groupBy(key).agg(
        best(picture & (F.col("height") <= 1080), F.col("height"), F.col("bandwidth")).alias("v"),
        best(sound, F.col("bandwidth")).alias("a"), best(combined, F.col("bandwidth")).alias("c"), small.alias("s"),
    )
    return picked.select(
        key, F.coalesce(-F.col("v.e"), F.col("s.i")).alias("video_idx"), (-F.col("a.e")).alias("audio_idx"),
        (-F.col("c.e")).alias("combined_idx"),
    )


def link_list(url: Column, backups: Column) -> Column:
    """Address and backups, trimmed, non-blank, distinct in order."""
    every = F.concat(F.array(url), F.coalesce(backups, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(every, lambda u: strip(u)), lambda u: u.isNotNull() & (u != "")))


def first_success(attempts: DataFrame, max_tries: int = 12) -> DataFrame:
    """attempts(video_id, ord, url, ok, error): first working link of the first tries, failures before it in order."""
    tried = attempts.where(F.col("ord") <= max_tries)
    win = F.min(F.when(F.col("ok"), F.struct("ord", "url"))).over(Window.partitionBy("video_id"))
    before = ~F.col("ok") & (F.col("w").isNull() | (F.col("ord") < F.col("w.ord")))
    picked = tried.withColumn("w", win).groupBy("video_id").agg(
        F.first("w").alias("w"), F.array_sort(F.collect_list(F.when(before, F.struct("ord", "error")))).alias("f"))
    return picked.select("video_id", F.col("w.url").alias("url"), F.col("w.ord").alias("tries"),
                         F.array_join(F.transform("f", lambda x: x.error), " | ").alias("failures"))


def plan_renditions(videos: DataFrame, keep_at_least: float = 0.40, same: float = 0.002) -> DataFrame:
    """videos(width, height, ...) to one row per target aspect: action and even-pixel crop geometry."""
    targets = F.array(*[
        F.struct(F.lit(n).alias("aspect"), F.lit(w).alias("target_w"), F.lit(h).alias("target_h"))
        for n, (w, h) in rules.ASPECT_TARGETS.items()
    ])
    rows = videos.withColumn("_t", F.explode(targets)).select(*videos.columns, "_t.*")
    w, h = F.col("width"), F.col("height")
    have, want = w / h.cast("double"), F.col("target_w") / F.col("target_h").cast("double")
    even = lambda c: (c - c % 2).cast("int")
    wide = have > want
    cut_w, cut_h = even(F.least(w, F.bround(h * want))), even(F.least(h, F.bround(w / want)))
    crop_w, crop_h = F.when(wide, cut_w).otherwise(even(w)), F.when(wide, even(h)).otherwise(cut_h)
    x = F.when(wide, even(F.greatest(F.lit(0), F.floor((w - cut_w) / 2)))).otherwise(0)
    y = F.when(wide, 0).otherwise(even(F.greatest(F.lit(0), F.floor((h - cut_h) / 2))))
    retention = F.least(have, want) / F.greatest(have, want)
    action = F.when(F.abs(have - want) <= same, "copy").when(retention >= keep_at_least, "crop").otherwise("blur_fill")
    crop = lambda c: F.when(F.col("action") == "crop", c)
    return rows.withColumn("retention", retention).withColumn("action", action).withColumns({
        "crop_w": crop(crop_w), "crop_h": crop(crop_h), "crop_x": crop(x), "crop_y": crop(y),
    })


def assign(items: DataFrame, name: str, choices: DataFrame, choice: str) -> DataFrame:
    """Deterministic choice per item: first 32 bits of SHA-1 of the name, modulo the sorted choices."""
    # Even ranges of the choices are the slices: numbering stays in binary order and never runs over all in one task.
    ranges = choices.select(choice).distinct().repartitionByRange(choice).withColumns({"_range": F.spark_partition_id(), "_all": F.lit(1)})
    catalogue = written(ranges, "choices")
    ranked = dense_ids(catalogue, ["_all"], [choice], "_slot", F.col("_range").cast("double"), 1.0).drop("_all", "_range")
    total = choices.agg(F.count_distinct(choice).alias("n")).scalar()
    bits = F.conv(F.left(F.sha1(F.col(name)), F.lit(8)), 16, 10).cast("long")
    return items.withColumn("_slot", bits % total).join(ranked, "_slot", "left").drop("_slot")


def stage_signatures(items: DataFrame, config: dict[str, list[str]]) -> DataFrame:
    """Cascaded signatures: each stage hashes its settings together with the stage before it."""
    upstream = F.lit("")
    for stage, columns in config.items():
        signature = F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns], upstream.alias("upstream")), {"ignoreNullFields": "false"}), 256)
        items = items.withColumn(f"sig_{stage}", signature)
        upstream = F.col(f"sig_{stage}")
    return items


def wanted_stages(items: DataFrame, config: dict[str, list[str]], key: str = "item_id") -> DataFrame:
    """One row per (item, stage) with the signature its artifact must have."""
    signed = stage_signatures(items, config)
    stages = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage"), F.col(f"sig_{s}").alias("signature"))
                       for i, s in enumerate(config)])
    return signed.select(key, F.explode(stages).alias("s")).select(key, "s.*")


def plan_stages(items: DataFrame, artifacts: DataFrame, config: dict[str, list[str]], key: str = "item_id") -> DataFrame:
    """wanted_stages with cached = an artifact with this very signature exists.

    A changed early stage changes every later signature, so what follows is recomputed too.
    """
    stored = artifacts.select(key, "stage", "signature").distinct().withColumn("cached", F.lit(True))
    joined = wanted_stages(items, config, key).join(stored, [key, "stage", "signature"], "left")
    return joined.withColumn("cached", F.coalesce("cached", F.lit(False)))
