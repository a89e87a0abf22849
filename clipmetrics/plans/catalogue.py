"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from clipmetrics.plans import captions, discovery, history, media, pages, streams, subtitles
from clipmetrics.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
PARTS = [discovery, history, captions, subtitles, media, pages, streams]


def _prepared(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _prepared(query) for part in PARTS for name, (query, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
