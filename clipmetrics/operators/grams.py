"""Substring search as a join: a gram index of texts meets needles keyed on their rarest inner gram.

A needle can only be in a text that holds each of its grams, so one of them is enough to find all candidates. Counts of
hashed grams in all texts say which one is the rarest; a very frequent gram is dealt to several keys. Only grams
that are the key of some needle leave a text. Both tables that tell this have a fixed size, whatever the corpus and the
number of needles; where two grams share a bucket, that costs time only, as every candidate is looked up in its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 5  # code points; shorter needles are their own gram
COUNT_BITS, KEY_BITS = 20, 23
BLOCK = 1 << 16
FACTOR = np.uint64(0x9FB21C651E98DF25)


def gram_hashes(codes: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the sizes, a hash of the gram of so many code points that begins at each place."""
    running = np.zeros(len(codes), dtype=np.uint64)
    for size in range(1, max(sizes, default=0) + 1):
        running = running[:max(len(codes) - size + 1, 0)] * FACTOR + codes[size - 1:] + np.uint64(size)
        if size in sizes:
            mixed = (running ^ running >> np.uint64(32)) * FACTOR
            yield size, mixed ^ mixed >> np.uint64(29)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _blocks(texts: Iterator[tuple[int, str | None]], size: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts one after the other as code points, about `size` at a time: key and end of each, and all code points.

    A longer text comes in parts that overlap by a gram, so that every gram lies whole in one of them.
    """
    keys, held, n = [], [], 0
    for key, text in texts:
        for start in range(0, len(text or ""), size):
            part = text[start:start + size + GRAM - 1]
            keys.append(key)
            held.append(part)
            n += len(part)
            if n >= size:
                yield np.array(keys, np.int64), np.cumsum([len(p) for p in held]), code_points("".join(held))
                keys, held, n = [], [], 0
    if held:
        yield np.array(keys, np.int64), np.cumsum([len(p) for p in held]), code_points("".join(held))


def fixed_counts(df: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int, kind: str) -> np.ndarray:
    """How often each of 2^bits buckets is named, as numbers of a kind that stop at its maximum.

    `of` turns the batches of df into arrays of buckets. A task sends one counter per bucket; blocks of counters are
    added up by streaming tasks, and 2^bits numbers reach the driver.
    """
    size = min(BLOCK, 1 << bits)
    blocks, most = (1 << bits) // size, np.iinfo(kind).max

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, dtype=kind)
        for buckets in of(batches):
            if len(buckets) * 8 > len(table):
                table = np.minimum(np.bincount(buckets, minlength=len(table)) + table, most).astype(kind)
            else:
                values, n = np.unique(buckets, return_counts=True)
                table[values] = np.minimum(table[values] + n, most)
        for number, part in enumerate(table.reshape(blocks, size)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.tobytes()], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = -1, np.zeros(size, dtype=np.int64)

        def row() -> pa.RecordBatch:
            counts = np.minimum(total, most).astype(kind).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([counts], pa.binary())], names=["block", "counts"])

        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != number and number >= 0:
                    yield row()
                    total[:] = 0
                number = block
                total += np.frombuffer(counts.as_buffer(), kind)
        if number >= 0:
            yield row()

    schema = "block long, counts binary"
    summed = df.mapInArrow(count, schema).repartition("block").sortWithinPartitions("block").mapInArrow(add, schema)
    out = np.zeros((blocks, size), dtype=kind)
    for block, counts in summed.toArrow().to_pandas().itertuples(index=False):
        out[block] = np.frombuffer(counts, kind)
    return out.ravel()


def _text_buckets(sizes: set[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]:
    """Buckets of all grams; the few over the end of a text count too, which changes no result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, _, codes in _blocks((0, t.as_py()) for t in batch.column(0)):
                for _, hashes in gram_hashes(codes, sizes):
                    yield _bucket(hashes, COUNT_BITS)

    return run


def pieces(often: np.ndarray, hashes: np.ndarray, per_key: int) -> np.ndarray:
    """To how many keys a gram is dealt."""
    return -(-np.maximum(often[_bucket(hashes, COUNT_BITS)].astype(np.int64), 1) // per_key)


def candidates(texts: DataFrame, needles: DataFrame, per_key: int = 65_536) -> DataFrame:
    """key, needle: every pair of which the text (key long, text) may hold the needle (needle), and all that do.

    Nothing of either table goes through the driver but two tables of counters of fixed size.
    """
    lengths = needles.groupBy(F.least(F.length("needle"), F.lit(GRAM)).alias("n")).count().where("n > 0").collect()  # at most GRAM rows
    sizes = {r.n for r in lengths}
    often = fixed_counts(texts.select("text"), _text_buckets(sizes), COUNT_BITS, "<u4")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A needle under each of the keys that its rarest gram is dealt to."""
        for batch in batches:
            grams, salts, rows = [], [], []
            for row, needle in enumerate(batch.column(0).to_pylist()):
                (_, hashes), = gram_hashes(code_points(needle), {min(len(needle), GRAM)})
                rarest = hashes[int(np.argmin(often[_bucket(hashes, COUNT_BITS)]))]
                n = int(pieces(often, np.array([rarest]), per_key)[0])
                grams += [rarest] * n
                salts += range(n)
                rows += [row] * n
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(grams, np.uint64).view(np.int64)), pa.array(salts, pa.int64()),
                batch.column(0).take(pa.array(rows, pa.int64()))], names=["gram", "salt", "needle"])

    index = needles.mapInArrow(keyed, "gram long, salt long, needle string")

    def key_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield _bucket(batch.column(0).to_numpy().view(np.uint64), KEY_BITS)

    wanted = np.packbits(fixed_counts(index.select("gram"), key_buckets, KEY_BITS, "u1") > 0)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, ends, codes in _blocks(zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)))):
                for size, hashes in gram_hashes(codes, sizes):
                    bucket = _bucket(hashes, KEY_BITS)
                    at = np.flatnonzero(wanted[bucket >> 3] << (bucket & 7).astype(np.uint8) & 128)
                    text = np.searchsorted(ends, at, side="right")
                    whole = at + size <= ends[text]
                    hashes, text = hashes[at[whole]], text[whole]
                    order = np.lexsort((hashes, text))
                    hashes, text = hashes[order], text[order]
                    new = np.ones(len(text), dtype=bool)
                    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
                    hashes, key = hashes[new], keys[text[new]]
                    salt = (key & (1 << 62) - 1) % pieces(often, hashes, per_key)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes.view(np.int64)), pa.array(salt), pa.array(key)], names=["gram", "salt", "key"])

    found = texts.select("key", "text").mapInArrow(grams, "gram long, salt long, key long")
    return found.join(index, ["gram", "salt"]).select("key", "needle").distinct()
