"""Exact deduplication by skew-safe combining.

Copies are merged three times, each time on digest *and* whole content: inside every map task (the partial
aggregate), per salted digest group, and once more over the winners of the salts. However many copies one text has,
no task receives more than one row per map task and salt, and no more than `salts` rows in the last merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmetrics.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Text with only the letters A-Z lower-cased; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when their normalised contents are; the digest only routes them, so texts that share a digest but
    differ stay apart. The largest id of a class stays. A null text is empty and equal to other empty ones. A null id
    is smaller than any other; a class of null ids keeps null. Rows that repeat an id and a text are counted in
    group_size and get the same answer. An empty table gives no rows. Other columns are ignored.
    """
    norm = normalised(F.col(text_col))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("content"), digest(norm).alias("digest"))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "content").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    )
    winners = (
        salted.repartition("digest").groupBy("digest", "content")
        .agg(F.max("winner").alias("keep_id"), F.sum("n").alias("group_size"))
    )
    # Content stays only where a digest has more than one, so what is joined back carries no texts.
    winners = written(
        winners.withColumn("contents", F.count(F.lit(1)).over(Window.partitionBy("digest")))
        .withColumn("content", F.when(F.col("contents") > 1, F.col("content"))), "exact-winners")
    plain = rows.select("doc_id", "digest").join(winners.where("contents = 1").drop("content"), "digest")
    # Digests of more than one content: with SHA-256 none, so the hint is on a side of proven size.
    several = winners.where("contents > 1")
    odd = rows.join(F.broadcast(several.select("digest").distinct()), "digest").join(several, ["digest", "content"])
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    return plain.select(columns).unionByName(odd.select(columns)).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def keep_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The rows of df that stay, with all their columns, one for each class of equal texts.

    Of rows that repeat the winning id and text one stays: the one that comes first by its other columns' JSON.
    """
    mark = "__exact_digest"
    marked = df.withColumn(mark, sha256(normalised(F.col(text_col))))
    stays = (
        exact_classes(df, id_col, text_col, salts).where("kept")
        .groupBy(F.col("digest").alias("__d")).agg(F.max("doc_id").alias("__id"))
    )
    joined = marked.join(stays, (F.col(mark) == F.col("__d")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left_semi")
    others = [F.col(c).cast("string") for c in df.columns if c not in (id_col, text_col)]
    order = Window.partitionBy(mark).orderBy(F.xxhash64(*others), F.col(text_col)) if others else Window.partitionBy(mark).orderBy(text_col)
    return joined.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop(mark, "__n")
