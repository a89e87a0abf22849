"""Word vectors by random indexing, pooled per document.

Every token has two names: a word bucket (hash of its lower-cased letters, digits or symbols) and a shape (case and
length of letters, length of digits, kind of symbol, or a repeat). Each name owns a sparse random index vector; its word vector is
the sum of the index vectors of the neighbours of all its occurrences in the corpus. The table of names has a fixed
size, so its sums are small whatever the corpus, and they are integers, so they do not depend on the order of adding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmetrics.llm.superkmers import word_hashes
from clipmetrics.llm.words import SPACE, slices, text_buffer

WORDS, SHAPES, WIDTH = 8192, 64, 32
LETTER, DIGIT, SYMBOL = 1, 2, 3
REPEAT = 62  # the shape of a word that is the word before it
CLASS = np.full(256, SYMBOL, dtype=np.uint8)
CLASS[SPACE] = 0
CLASS[ord("0"):ord("9") + 1] = DIGIT
CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = LETTER
#: A number below 34 for every ASCII symbol, in their order.
SYMBOL_KIND = np.zeros(256, dtype=np.int64)
SYMBOL_KIND[[b for b in range(33, 127) if CLASS[b] == SYMBOL]] = np.arange(32)


@lru_cache(maxsize=1)
def index_vectors(seed: int = 23, ones: int = 4) -> np.ndarray:
    """Sparse vectors of +1 and -1 for all names, equally many of each sign; the same everywhere."""
    rng = np.random.default_rng(seed)
    out = np.zeros((WORDS + SHAPES, WIDTH), dtype=np.int64)
    for row in out:
        at = rng.choice(WIDTH, ones, replace=False)
        row[at[:ones // 2]], row[at[ones // 2:]] = 1, -1
    return out


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket and shape of every token of the texts, and the number of tokens before each text (n + 1 values)."""
    data, offsets = text_buffer(column)
    kind = CLASS[data]
    begins = kind != 0
    begins[1:] &= kind[1:] != kind[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = kind[inner] != 0
    starts = np.flatnonzero(begins)
    ends = kind != 0
    ends[:-1] &= kind[1:] != kind[:-1]
    last = inner[inner > 0] - 1
    ends[last] = kind[last] != 0
    ends = np.flatnonzero(ends) + 1
    capital = (data >= 65) & (data <= 90)
    capitals = np.concatenate([[0], np.cumsum(capital)])
    words = (word_hashes(data + 32 * capital.astype(np.uint8), starts, ends) % np.uint64(WORDS)).astype(np.int64)
    size = ends - starts
    length = np.minimum(np.searchsorted([1, 2, 4, 8, 16], size), 5)
    upper, own = capitals[ends] - capitals[starts], kind[starts]
    case = np.where(upper == 0, 0, np.where((upper == size) & (size > 1), 2, np.where((upper == 1) & capital[starts], 1, 3)))
    shape = np.where(own == LETTER, 6 * case + length, np.where(own == DIGIT, 24 + length, 30 + SYMBOL_KIND[data[starts]]))
    first = np.searchsorted(starts, offsets)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (own[1:] == LETTER)
    again[first[:-1][first[:-1] < len(words)]] = False
    return words, WORDS + np.where(again, REPEAT, shape), first


def contexts(df: DataFrame, text_col: str = "text", reach: int = 2) -> np.ndarray:
    """Word vectors of all names, of unit length and without their common part, from every text of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        sums = np.zeros((WORDS + SHAPES, WIDTH))
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words, shapes, first = tokens(part.column(0))
                # Texts stand apart by more places than a neighbour can be away.
                place = np.arange(len(words)) + reach * (1 + np.repeat(np.arange(len(first) - 1), np.diff(first)))
                row = np.zeros(len(words) + reach * (len(first) + 1))
                for d in range(WIDTH):
                    row[place] = index[words, d] + index[shapes, d]
                    near = sum(row[place - k] + row[place + k] for k in range(1, reach + 1))
                    sums[:, d] += np.bincount(words, near, WORDS + SHAPES) + np.bincount(shapes, near, WORDS + SHAPES)
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(list(sums[used].astype(np.int64)), pa.list_(pa.int64()))], names=["name", "sums"])

    rows = df.select(df[text_col].cast("string").alias("text")).mapInArrow(run, "name long, sums array<long>")
    totals = rows.groupBy("name").agg(*[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(WIDTH)]).collect()
    table = np.zeros((WORDS + SHAPES, WIDTH))
    for row in totals:
        table[row[0]] = row[1:]
    norm = np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1)
    table = table / norm
    common = table[norm[:, 0] > 1].mean(axis=0) if (norm > 1).any() else 0
    return np.where(norm > 1, table - common, 0).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Of every text the mean vector of its words, and the mean and spread of its shapes; zero without tokens."""
    words, shapes, first = tokens(column)
    n, counts = len(first) - 1, np.diff(first)
    owner = np.repeat(np.arange(n), counts)
    by_shape = np.bincount(owner * SHAPES + shapes - WORDS, minlength=n * SHAPES).reshape(n, SHAPES)
    full = counts > 0
    sums = np.zeros((n, WIDTH), np.float32)
    if full.any():
        sums[full] = np.add.reduceat(vectors[words], first[:-1][full], axis=0)
    size = np.maximum(counts, 1)[:, None]
    mean = by_shape @ vectors[WORDS:] / size
    spread = np.sqrt(np.maximum(by_shape @ vectors[WORDS:] ** 2 / size - mean**2, 0))
    return np.concatenate([sums / size, mean, spread], axis=1).astype(np.float32)
