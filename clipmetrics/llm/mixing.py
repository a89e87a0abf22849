"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree.

Every document of a source starts with the same expected number of copies. Its whole part is taken; the fractional
rest is rounded jointly: two documents at a time exchange mass, measured in words, in a random direction until one of
them is integral. The exchange keeps every expectation and the source's total words. Blocks of a source are reduced in
parallel, each leaves one fractional document, and these meet on the next level until one is left per source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmetrics.llm.words import word_counts
from clipmetrics.session import written

COLUMNS = (
    "doc_id long, source string, source_no long, size long, source_size long, target double, whole long, p double, "
    "block long, settled boolean"
)


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source and the number of words of every row; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array(word_counts(batch.column(2)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["doc_id", "source", "size"])

    return df.select(
        df[id_col].cast("long").alias("doc_id"), df[source_col].cast("string").alias("source"),
        df[text_col].cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, source string, size long")


def targets(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_no, source_size, docs, target: one row per source.

    Sources in code-point order, null last, weigh `weights` in turn and share `share` times all words by weight; no
    target exceeds `most` times its source's words, and the excess is shared again by weight. That ends at one common
    level: each target is the smaller of its bound and level * weight, and the level is the largest of
    (total - bounds below k) / (weights from k on) over the sources in the order of bound / weight.
    The frame has one row per source, so its windows stay small whatever the number of documents.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ordered = by_source.withColumn("source_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    ordered = ordered.withColumn("weight", weight).withColumn("bound", most * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("bound") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(F.col("bound") / F.col("weight"), "source_no").rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        ordered.withColumn("level_from", level).withColumn("level", F.max("level_from").over(everything))
        .select("source", F.col("source_no").cast("long").alias("source_no"), "source_size", "docs",
                F.least("bound", F.col("level") * F.col("weight")).alias("target"))
    )


def _unit(a: int | None, b: int | None, seed: int) -> float:
    """A number in [0, 1) that depends on the two documents and the seed alone."""
    x = ((a or 0) * 0x9E3779B97F4A7C15 + (b or 0) * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & (1 << 64) - 1
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & (1 << 64) - 1
    return (x ^ x >> 31) / 2.0**64


def transfer(p: float, s: int, q: float, t: int, u: float) -> tuple[float, float]:
    """New copy probabilities of two documents of s and t words; at least one of them is 0 or 1.

    Words leave one document for the other, either way as many as the bounds allow; u picks the way with the odds that
    keep both expectations.
    """
    up = min((1 - p) * s, q * t)
    down = min(p * s, (1 - q) * t)
    if u * (up + down) < down:
        moved, p_full, q_full = up, (1 - p) * s <= q * t, q * t <= (1 - p) * s
        return (1.0 if p_full else p + moved / s), (0.0 if q_full else q - moved / t)
    moved, p_empty, q_full = down, p * s <= (1 - q) * t, (1 - q) * t <= p * s
    return (0.0 if p_empty else p - moved / s), (1.0 if q_full else q + moved / t)


def _reduce(seed: int, last: bool):
    """Streams rows sorted by (source_no, block) and from long to short; keeps one open document at a time.

    A long open document passes its mass to shorter ones until it is integral, so what stays open is short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        schema = None

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        def closed(row: dict) -> dict:
            return row | ({"p": float(row["p"] >= 0.5), "settled": True} if last else {})

        for batch in batches:
            schema, done = batch.schema, []
            for row in batch.to_pylist():
                if held is not None and (held["source_no"], held["block"]) != (row["source_no"], row["block"]):
                    done.append(closed(held))
                    held = None
                if held is None:
                    held = row
                    continue
                held["p"], row["p"] = transfer(held["p"], held["size"], row["p"], row["size"], _unit(held["doc_id"], row["doc_id"], seed))
                open_rows = []
                for x in (held, row):
                    (done if x["p"] in (0.0, 1.0) else open_rows).append(x)
                    x["settled"] = x["p"] in (0.0, 1.0)
                held = open_rows[0] if open_rows else None
            yield out(done)
        if held is not None:
            yield out([closed(held)])

    return run


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, block_docs: int = 2048,
    fan_in: int = 64, seed: int = 17,
) -> DataFrame:
    """One row per row of df: doc_id, source, size, source_size, target, copies, taken = copies * size.

    A source's words taken differ from its target by no more than half of one of its documents; copies are the whole
    part of target / source_size or one more. The draw depends on doc_ids, sizes and the seed only, so reruns agree.
    Texts without words (null, empty) and sources without words take nothing; a null source is a source of its own,
    last in order; null ids count as 0 in the draw; rows that repeat are drawn each; an empty table gives no rows;
    other columns are ignored.
    """
    sized = written(sizes(df, id_col, text_col, source_col), "mix-sizes")
    by_source = written(targets(sized, weights, share, most), "mix-targets")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    rows = (
        sized.alias("d").join(by_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.doc_id", "d.source", "source_no", "size", "source_size", "target", F.floor(rate).alias("whole"),
                (rate - F.floor(rate)).alias("p"),
                F.pmod(F.xxhash64("d.doc_id"), F.ceil(F.col("docs") / block_docs)).alias("block"))
        .withColumn("settled", (F.col("p") == 0) | (F.col("size") == 0))
    )
    blocks = by_source.agg(F.max(F.ceil(F.col("docs") / block_docs))).first()[0] or 1
    settled = rows.where("settled").withColumn("p", F.lit(0.0))
    open_rows = rows.where("not settled")
    level = 0
    while True:
        last = blocks == 1
        ordered = open_rows.repartition("source_no", "block").sortWithinPartitions("source_no", "block", F.desc("size"), "doc_id")
        reduced = written(ordered.mapInArrow(_reduce(seed + level, last), COLUMNS), f"mix-level-{level}")
        settled = settled.unionByName(reduced.where("settled"))
        if last:
            break
        blocks, level = -(-blocks // fan_in), level + 1
        open_rows = reduced.where("not settled").withColumn("block", (F.col("block") / fan_in).cast("long"))
    copies = (F.col("whole") + F.col("p")).cast("long")
    return settled.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """The rows of df, each as often as the mix takes it. Rows that share an id share the largest number drawn for it."""
    copies = (
        mix(df, id_col, text_col, source_col, **parameters)
        .groupBy(F.col("doc_id").alias("__mix_id")).agg(F.max("copies").alias("__mix_copies"))
    )
    return (
        df.join(copies.where("__mix_copies > 0"), F.col(id_col).cast("long").eqNullSafe(F.col("__mix_id")))
        .withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in df.columns])
    )
