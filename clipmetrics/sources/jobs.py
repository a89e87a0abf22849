"""Stored job tables: decoding, defaults for older files, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics import schemas


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns an older table lacks are added, nulls in the others replaced."""
    have = set(df.columns)
    return df.withColumns({n: F.coalesce(F.col(n), v) if n in have else v for n, v in defaults.items()})


DEFAULTS = {"mode": "dub", "aspect": "original", "attempts": 1, "subtitle_revision": 0}


def decode_jobs(rows: DataFrame) -> DataFrame:
    """Stored job rows with JSON text columns and nanosecond times to typed columns."""
    whole = with_defaults(rows, {n: F.lit(v) for n, v in DEFAULTS.items()})
    time = lambda c: F.timestamp_micros(F.floor(F.col(c) / 1000).cast("bigint"))
    return whole.select(
        "job_id", "status", F.from_json("video_json", schemas.JOB_VIDEO).alias("video"), "mode", "aspect",
        F.from_json("outputs_json", "map<string,string>").alias("outputs"), "attempts", "subtitle_revision",
        F.from_json("localization_json", schemas.LOCALIZATION).alias("localization"), "error",
        time("created_ns").alias("created_at"), time("updated_ns").alias("updated_at"),
    )


def encode_jobs(jobs: DataFrame) -> DataFrame:
    """Typed job rows back to the stored form."""
    nanos = lambda c: (F.unix_micros(c) * 1000)
    return jobs.select(
        "job_id", "status", F.to_json("video").alias("video_json"), "mode", "aspect", F.to_json("outputs").alias("outputs_json"),
        "attempts", "subtitle_revision", F.to_json("localization").alias("localization_json"), "error",
        nanos("created_at").alias("created_ns"), nanos("updated_at").alias("updated_ns"),
    )


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of a Parquet table, newest first; files written before a column existed are merged in."""
    return decode_jobs(spark.read.option("mergeSchema", "true").parquet(path)).orderBy(F.col("created_at").desc())


def read_jobs_jdbc(spark: SparkSession, url: str, table: str, bounds: tuple[int, int], partitions: int) -> DataFrame:
    """Jobs of a relational store through JDBC, read in parallel ranges of the update time."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", "updated_ns")
    reader = reader.option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return decode_jobs(reader.load())


def write_jobs(jobs: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by update day, so a scan for recent jobs skips the rest."""
    day = F.to_date(F.timestamp_micros(F.floor(F.col("updated_ns") / 1000).cast("bigint")))
    encode_jobs(jobs).withColumn("day", day).write.mode(mode).partitionBy("day").parquet(path)
