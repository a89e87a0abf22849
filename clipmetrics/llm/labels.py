"""Bounded, reproducible samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def picked_labels(labels: DataFrame, label_col: str, allowed: Column, most: dict[int, int], id_col: str = "doc_id") -> DataFrame:
    """id and label of at most most[label] documents of each label, in the order of the hash of their ids.

    Only ids for which `allowed` (over the column id) holds are read; conflicting labels of an id count as the larger
    one; labels that are null or not in `most` are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & allowed).groupBy("id").agg(F.max("label").alias("label"))
    picked = None
    for label, n in most.items():
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    return picked


def with_labels(docs: DataFrame, picked: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 1 << 16) -> DataFrame:
    """id, text and label of the picked documents of at most max_bytes; their ids are bounded, so they are broadcast."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.where(F.octet_length("text") <= max_bytes).join(F.broadcast(picked), "id").select("id", "text", "label")


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, allowed: Column, most: dict[int, int]) -> list[tuple[str, int]]:
    """(text, label) of the picked documents, in the order of their ids; the sample is bounded by its parameters."""
    rows = with_labels(docs, picked_labels(labels, label_col, allowed, most)).collect()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: (r.id, r.text))]
