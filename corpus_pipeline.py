"""A corpus from raw documents to packed sequences, in five written stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics.llm import exact, lexical, mixing, plans, simhash, toxicity
from clipmetrics.llm.labels import fold
from clipmetrics.session import ship_package, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SCORE = "__toxicity"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the scorer learns from the labels that op4_toxicity learns from."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = toxicity.fit(docs, labels, fold(F.col("id"), 3) != 1)
    return toxicity.with_score(docs, scorer, score_col=SCORE).where(F.col(SCORE) < 0.7).drop(SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts stays, the one with the largest doc_id."""
    return exact.keep_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints stays, the one with the smallest doc_id."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a document that the mix takes twice is packed twice."""
    return plans.pieces(lexical.pack_lexical(docs))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("source mix", mix_sources), ("packing", pack),
]

#: SQL can express neither the trained scorer nor the greedy packing; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; each result is written and read again, the last one returned."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
