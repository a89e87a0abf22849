"""SimHash near-duplicates, verified through tables of distances to reference fingerprints.

Two fingerprints within four bits agree wholly on one of five bit blocks, so rows meet by (block, its bits). Inside a
meeting a table of Hamming distances to reference fingerprints (pivots) discards every pair whose distances differ by
more than four on any pivot; the rest is verified bit by bit. A meeting gives back a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clipmetrics.llm.components import components
from clipmetrics.llm.words import joined, slices, text_buffer, word_bounds
from clipmetrics.session import written

SEED = 42


def _majority(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For every run of hashes the number whose bits are set in more than half of the run."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sizes = np.diff(np.append(begins, len(hashes)))
    counts = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(column: pa.Array, width: int = 4) -> np.ndarray:
    """The SimHash of every text over its lower-cased word shingles; a text without words has zero."""
    data, offsets = text_buffer(column)
    capital = (data >= 65) & (data <= 90)
    starts, ends, first = word_bounds(data, offsets)
    buffer, starts, ends = joined(data + 32 * capital.astype(np.uint8), starts, ends)
    words = np.diff(first)
    shingles = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    ends_at = np.minimum(np.arange(len(starts)) + width, np.repeat(first[1:], words)) - 1
    has = np.arange(len(starts)) - np.repeat(first[:-1], words) < np.repeat(shingles, words)
    raw, digest = buffer.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[a:b], SEED) for a, b in zip(starts[has].tolist(), ends[ends_at[has]].tolist())), np.uint64, int(has.sum()))
    out = np.zeros(len(words), dtype=np.uint64)
    full = shingles > 0
    if full.any():
        out[full] = _majority(hashes, (np.cumsum(shingles) - shingles)[full])
    return out


def fingerprint_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                marks = pa.array(fingerprints(part.column(1), width).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), marks], names=["doc_id", "fp"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def pivots(n: int, seed: int = 7) -> np.ndarray:
    """Reference fingerprints; the same everywhere."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.arange(n, dtype=np.uint64) % 2


def _find(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    root = parent[at]
    while True:
        up = parent[root]
        if (up == root).all():
            return root
        root = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        ra, rb = _find(parent, a), _find(parent, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        parent[np.maximum(ra, rb)] = np.minimum(ra, rb)


def forest(left: np.ndarray, right: np.ndarray | None, bits: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between left and right, or among left alone where right is None."""
    both = left if right is None else np.concatenate([left, right])
    table = np.bitwise_count(both[:, None] ^ references[None, :]).astype(np.int16)
    order_l = np.argsort(table[:len(left), 0], kind="stable")
    order_r = order_l if right is None else len(left) + np.argsort(table[len(left):, 0], kind="stable")
    near = table[order_r, 0]
    parent = np.arange(len(both))
    for at in range(0, len(order_l), 128):
        rows = order_l[at:at + 128]
        low, high = np.searchsorted(near, [table[rows[0], 0] - bits, table[rows[-1], 0] + bits + 1])
        others = order_r[max(low, at if right is None else 0):high]
        kept = np.ones((len(rows), len(others)), dtype=bool)
        for k in range(len(references)):
            kept &= np.abs(table[rows, k][:, None] - table[others, k][None, :]) <= bits
        a, b = np.nonzero(kept)
        a, b = rows[a], others[b]
        close = np.bitwise_count(both[a] ^ both[b]) <= bits
        _unite(parent, a[close], b[close])
    root = _find(parent, parent)
    linked = np.flatnonzero(root != np.arange(len(both)))
    return both[linked], both[root[linked]]


def links(marks: DataFrame, bits: int = 4, references: int = 8, meeting: int = 4096) -> DataFrame:
    """u, v: enough of the links between the distinct values of marks.fp to connect all that are within `bits`.

    A meeting of more than `meeting` rows is cut into pieces by hash, and every two pieces meet in a group of their
    own, so no group exceeds twice that size on average and none is left out.
    """
    blocks = bits + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", edges[k]).bitwiseAND((1 << edges[k + 1] - edges[k]) - 1).alias("part"))
        for k in range(blocks)
    ])
    rows = marks.select("fp").where("fp is not null").distinct().select("fp", F.inline(keys))
    large = rows.groupBy("block", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > meeting)
    rows = (
        rows.join(large, ["block", "part"], "left")
        .withColumn("pieces", F.coalesce(F.ceil(F.col("n") / meeting), F.lit(1)).cast("int"))
        .withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("fp", "block", "part", "piece", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"))
    )
    fixed = pivots(references)

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        u = v = np.zeros(0, dtype=np.uint64)
        if len(fp) > 1:
            low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
            piece = table.column("piece").to_numpy()
            u, v = forest(fp, None, bits, fixed) if low == high else forest(fp[piece == low], fp[piece == high], bits, fixed)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return rows.groupBy("block", "part", "low", "high").applyInArrow(run, "u long, v long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4,
) -> DataFrame:
    """One row per row of df: doc_id, fp, root (the component's smallest linked fingerprint), component_id.

    component_id is the smallest doc_id that links reach. Null and empty texts have fingerprint zero and are linked
    like any other; null ids are no candidates for component_id, which is null only where a component has no other
    ids; rows that repeat give a row each; an empty table gives no rows; other columns are ignored.
    """
    marks = written(fingerprint_table(df, id_col, text_col, width), "simhash")
    roots = components(links(marks, bits)).withColumnRenamed("u", "fp")
    members = (
        marks.groupBy("fp").agg(F.min("doc_id").alias("first"))
        .join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    )
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    return marks.join(members.select("fp", "root").join(least, "root"), "fp").select("doc_id", "fp", "root", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns: of each component the document with the smallest id.

    Of rows that repeat that id within a component one stays, the first by the hash of its other columns.
    """
    found = near_duplicates(df, id_col, text_col)
    stays = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root").agg(F.first("doc_id").alias("__sim_id"), F.min("fp").alias("__sim_fp"))
    )
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                marks = pa.array(fingerprints(part.column(part.schema.get_field_index(text_col))).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, marks], names=[*columns, "__sim_mark"])

    schema = StructType([*df.schema.fields, StructField("__sim_mark", LongType())])
    marked = df.mapInArrow(run, schema)
    kept = marked.join(
        stays, (F.col("__sim_mark") == F.col("__sim_fp")) & F.col(id_col).cast("long").eqNullSafe(F.col("__sim_id")), "left_semi")
    others = [F.col(f"`{c}`").cast("string") for c in columns]
    order = Window.partitionBy("__sim_mark", id_col).orderBy(F.xxhash64(*others))
    return kept.withColumn("__sim_n", F.row_number().over(order)).where("__sim_n = 1").drop("__sim_mark", "__sim_n")
