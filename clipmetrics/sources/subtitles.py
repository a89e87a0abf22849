"""Subtitle files and segment metadata: read, write, check."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from clipmetrics import rules, schemas
from clipmetrics.functions import regions, text
from clipmetrics.functions.text import strip
from clipmetrics.operators.ordered import row_numbers, with_slices
from clipmetrics.sources.formats import register_formats

TIMING = r"(\d{2}:\d{2}:\d{2}[,.]\d{3})\s+-->\s+(\d{2}:\d{2}:\d{2}[,.]\d{3})"


def _plain(col: Column) -> Column:
    """Without byte order mark, line ends as newlines."""
    bare = F.when(F.startswith(col, F.lit("\ufeff")), F.substr(col, F.lit(2))).otherwise(col)
    newlines = F.replace(F.replace(bare, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(F.contains(col, F.lit("\r")), newlines).otherwise(bare)


def parse_srt(files: DataFrame, keep: list[str], content: str = "content", joiner: str = "\n") -> DataFrame:
    """Subtitle texts to cues: (keep, block_no, start_s, end_s, text); blocks without time, span or body are dropped."""
    blocks = files.select(*keep, F.posexplode(F.split(strip(_plain(F.col(content))), r"\n\s*\n")).alias("block_no", "block"))
    lines = F.filter(F.split("block", r"\n"), lambda line: strip(line) != "")
    rows = blocks.select(*keep, "block_no", lines.alias("_lines")).where(F.size("_lines") > 0)
    head = F.when(F.rlike(strip(F.get("_lines", F.lit(0))), F.lit(r"^\d+$")), 1).otherwise(0)
    rows = rows.withColumn("_at", head).withColumn("_time", F.get("_lines", F.col("_at")))
    body = F.slice("_lines", F.col("_at") + 2, F.greatest(F.lit(0), F.size("_lines") - F.col("_at") - 1))
    timed = rows.select(
        *keep, "block_no", text.srt_seconds(F.regexp_extract("_time", TIMING, 1)).alias("start_s"),
        text.srt_seconds(F.regexp_extract("_time", TIMING, 2)).alias("end_s"),
        strip(F.array_join(F.transform(body, lambda line: F.rtrim(line)), joiner)).alias("text"), F.rlike("_time", F.lit(TIMING)).alias("_ok"),
    )
    return timed.where(F.col("_ok") & (F.col("end_s") > F.col("start_s")) & (F.col("text") != "")).drop("_ok")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of all subtitle files below a path, keyed by file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    return parse_srt(files, ["file"])


def srt_blocks(cues: DataFrame, key: str = "video_id", slice_seconds: float = 600.0) -> DataFrame:
    """cues(key, ord, start_s, end_s, text) to numbered subtitle blocks; blank texts keep their number but are left out."""
    numbered = row_numbers(with_slices(cues, F.col("start_s"), slice_seconds), [key], ["start_s", "ord"], "block_no")
    body = F.replace(strip("text"), F.lit("\n"), F.lit(" "))
    block = F.concat(F.col("block_no").cast("string"), F.lit("\n"), text.srt_time(F.col("start_s")), F.lit(" --> "), text.srt_time(F.col("end_s")),
                     F.lit("\n"), body, F.lit("\n"))
    return numbered.where(strip("text") != "").select(key, "block_no", block.alias("block"))


def write_srt(cues: DataFrame, path: str, key: str = "video_id") -> None:
    """One folder per video with its blocks in order. Range partitioning by (video, number) also splits a very
    long video over several part files, whose names sort in block order.
    """
    blocks = srt_blocks(cues, key)
    ordered = blocks.repartitionByRange(key, "block_no").sortWithinPartitions(key, "block_no")
    ordered.select(key, F.col("block").alias("value")).write.partitionBy(key).text(path)


def write_subtitles(cues: DataFrame, path: str, key: str = "video_id") -> None:
    """Archives of many videos each, through the subtitles format; a very long video is spread over several."""
    register_formats(cues.sparkSession)
    blocks = srt_blocks(cues, key).select(F.col(key).cast("string").alias("video"), F.col("block_no").cast("long").alias("part"), F.col("block").alias("content"))
    ordered = blocks.repartitionByRange("video", "part").sortWithinPartitions("video", "part")
    ordered.write.format("subtitles").mode("append").save(path)


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Cues of all subtitle files and archives below a path: (video, part, block_no, start_s, end_s, text)."""
    register_formats(spark)
    return parse_srt(spark.read.format("subtitles").load(path), ["video", "part"])


def _stripped(col: Column) -> Column:
    """strip(col) that looks at the last bytes first: trimming the right end walks over the whole text."""
    end = F.hex(F.substring(col.cast("binary"), -3, 3))
    return F.when(F.rlike(end, F.lit(text.WHITE_END)), strip(col)).otherwise(F.ltrim(col, F.lit(text.WHITESPACE)))


def normalized_srt(col: Column) -> Column:
    return F.concat(_stripped(_plain(col)), F.lit("\n"))


def validate_srt(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """(keep, ok, reason) of subtitle texts after normalising."""
    plain = files.select(*keep, _plain(F.col(content)).alias("_plain"))
    checked = plain.select(*keep, F.concat(_stripped(F.col("_plain")), F.lit("\n")).alias("_srt"))
    timing = r"(?m)^\s*\d{2}:\d{2}:\d{2}[,.]\d{3}\s+-->\s+\d{2}:\d{2}:\d{2}[,.]\d{3}"
    reason = (
        F.when(F.col("_srt") == "\n", "subtitle cannot be empty")
        .when(F.octet_length("_srt") > rules.MAX_SUBTITLE_BYTES, "subtitle exceeds 2 MiB limit")
        .when(~F.rlike("_srt", F.lit(timing)), "no timing line found")
    )
    return checked.select(*keep, reason.isNull().alias("ok"), reason.alias("reason"))


def segments_from_json(files: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Segment metadata texts to segments; rows without box or span are skipped, clean-up boxes default to details."""
    rows = files.select(*keep, F.from_json(F.col(content), schemas.SEGMENT_FILE).alias("f"))
    s = rows.select(*keep, F.posexplode("f.segments").alias("seg_id", "s"))
    good = s.where((F.size("s.bbox") == 4) & (F.coalesce(F.col("s.end"), F.col("s.start")) > F.coalesce(F.col("s.start"), F.lit(0.0))))
    shapes = lambda c: F.transform(F.filter(c, lambda b: F.size(b) == 4), lambda b: regions.normalized(regions.from_array(b), pad=False))
    details = shapes(F.coalesce("s.bboxRegions", F.array().cast("array<array<double>>")))
    cleanup = shapes(F.coalesce("s.cleanupRegions", "s.bboxRegions", F.array().cast("array<array<double>>")))
    return good.select(
        *keep, "seg_id", F.coalesce("s.start", F.lit(0.0)).alias("start_s"), F.col("s.end").alias("end_s"), F.col("s.text").alias("text"),
        regions.normalized(regions.from_array(F.col("s.bbox")), pad=False).alias("bbox"), details.alias("regions"), cleanup.alias("cleanup_regions"),
        F.lower(strip(F.coalesce("s.placement", F.lit("")))).alias("placement"), F.coalesce("s.bboxConfidence", F.lit(0.0)).alias("confidence"),
    )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all metadata files below a path, keyed by file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    return segments_from_json(files, "content", ["file"])


class SrtCues:
    """Table function form for SQL users; registered by register_srt_function."""

    def eval(self, content: str) -> Iterator[tuple]:
        plain = content.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").strip()
        seconds = lambda t: int(t[:2]) * 3600 + int(t[3:5]) * 60 + int(t[6:8]) + int(t[9:12]) / 1000.0
        for number, block in enumerate(re.split(r"\n\s*\n", plain)):
            found = re.search(TIMING + r"[^\n]*\n?(.*)", block, re.S)
            if found and seconds(found[2]) > seconds(found[1]) and found[3].strip():
                yield number, seconds(found[1]), seconds(found[2]), found[3].strip()


def register_srt_function(spark: SparkSession, name: str = "srt_cues") -> None:
    spark.udtf.register(name, udtf(SrtCues, returnType="block_no int, start_s double, end_s double, text string", useArrow=True))
