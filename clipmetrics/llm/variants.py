"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols. The strings one edit away from a word's reduced form (and the form itself, as an
edit may not show there) are generated as rolling hashes and joined with the reduced vocabulary; who meets is verified on
the original strings. Every pair is generated from one side only: what one word reaches by an insertion reaches it by a
deletion, and of two forms that differ in one symbol the one with the smaller symbol generates the other. A smaller
alphabet makes neighbourhoods smaller and more words that meet by chance.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmetrics.llm.superkmers import _powers, mixed
from clipmetrics.llm.words import slices
from clipmetrics.session import written

LETTERS = "A-Za-zÀ-ÿ"
OTHER = re.compile(f"[^{LETTERS}]")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SEED = np.uint64(0xC2B2AE3D27D4EB4F)


def parts_of(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in parts that end outside its runs of letters."""
    start = 0
    while len(text) - start > size:
        cut = OTHER.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def vocabulary(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, min_count: int = 2, garble: int = 31,
) -> DataFrame:
    """word, n: runs of letters of at least `shortest` code points that occur min_count times in all.

    Runs are lower-cased in A-Z. Where garble divides the crc32 of `<id>:<run>`, the run loses one code point first
    (0: never); a null id is written as an empty string.
    """
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for piece in parts_of(text or ""):
                        for run, n in Counter(runs.findall(piece)).items():
                            word = run.lower() if run.isascii() else run.translate(LOWER)
                            if garble and (h := crc32(word.encode(), start)) % garble == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1:]
                                if len(word) < shortest:
                                    continue
                            counts[word] += n
                if len(counts) > 100_000:
                    yield rows()
        if counts:
            yield rows()

    rows = df.select(df[id_col].cast("string").alias("id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def reduced(codes: np.ndarray, symbols: int) -> np.ndarray:
    """Code points as one of a few symbols."""
    return (mixed(codes.astype(np.uint64) + SEED) % np.uint64(symbols)).astype(np.int64)


def neighbourhoods(words: np.ndarray, symbols: int, budget: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """For reduced words of one length (row, place): rows and hashes of what they generate, and whether it is the words themselves.

    Besides them these are the strings one deletion or one greater symbol away, each once.

    The hash of a string is the sum of its symbols' values times the powers of an odd number, so that of an edited one
    follows from sums before and after the edit.
    """
    value = mixed(np.arange(1, symbols + 1, dtype=np.uint64)) | np.uint64(1)
    length = words.shape[1]
    up, down = _powers(max(length + 2, 64))
    step = max(budget // max((symbols + 1) * length, 1), 1)
    for low in range(0, len(words), step):
        part = words[low:low + step]
        before = np.zeros((len(part), length + 1), dtype=np.uint64)
        np.cumsum(value[part] * up[:length], axis=1, out=before[:, 1:])
        whole = before[:, -1:]
        own = np.arange(low, low + len(part))
        yield own, whole[:, 0], True
        span = max(budget // (len(part) * symbols), 1)
        for begin in range(0, length, span):
            place = np.arange(begin, min(begin + span, length))
            deleted = before[:, place] + (whole - before[:, place + 1]) * down[1]
            symbol = part[:, place, None]
            replaced = whole[:, :, None] + (value - value[symbol]) * up[place][None, :, None]
            row, at, new = np.nonzero(np.arange(symbols) > symbol)
            yield own[row], replaced[row, at, new], False
            # Taking out any of a row of equal symbols gives the same string.
            fresh = np.ones(deleted.shape, dtype=bool)
            inner = place[place > 0]
            fresh[:, len(place) - len(inner):] = part[:, inner] != part[:, inner - 1]
            row, at = np.nonzero(fresh)
            yield own[row], deleted[row, at], False


def _by_length(batch: pa.RecordBatch, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and reduced words of the rows of a batch, for each number of code points."""
    ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        codes = np.frombuffer("".join([words[i] for i in at]).encode("utf-32-le"), "<u4").reshape(len(at), size)
        yield ids[at], reduced(codes, symbols)


def near_words(words: DataFrame, symbols: int = 6) -> DataFrame:
    """word, near, near_n: all pairs, both ways round, of words that differ by one inserted, deleted or replaced code point.

    `words` has distinct words and their n. They are numbered by a hash of 64 bits.
    """
    numbered = words.withColumn("id", F.xxhash64("word"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word", 1 << 18):
                for ids, forms in _by_length(part, symbols):
                    up = _powers(max(forms.shape[1] + 2, 64))[0]
                    value = mixed(np.arange(1, symbols + 1, dtype=np.uint64)) | np.uint64(1)
                    hashes = (value[forms] * up[:forms.shape[1]]).sum(axis=1, dtype=np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids)], names=["form", "id"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word", 1 << 18):
                for ids, forms in _by_length(part, symbols):
                    for at, hashes, same in neighbourhoods(forms, symbols):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(hashes.view(np.int64)), pa.array(ids[at]), pa.array(np.full(len(at), same))], names=["form", "of", "same"])

    rows = numbered.select("id", "word")
    forms, edited = rows.mapInArrow(own, "form long, id long"), rows.mapInArrow(around, "form long, of long, same boolean")
    # Words of one form find each other from both sides, all others from one.
    pairs = edited.join(forms, "form").where(~F.col("same") | (F.col("of") < F.col("id"))).select("of", "id")
    left = numbered.select(F.col("id").alias("of"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = numbered.select("id", F.col("word").alias("b"), F.col("n").alias("b_n"))
    found = pairs.join(left, "of").join(right, "id").where(F.levenshtein("a", "b", 1) == 1)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                    F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return found.select(F.explode(sides).alias("p")).select("p.word", "p.near", "p.near_n")


def roots(forms: DataFrame, most: int = 64) -> DataFrame:
    """word, root: the last word of the chain of forms of every word that has one, by doubling."""
    steps = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while most:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(onward, "root", "left")
        if joined.where(F.col("next").isNotNull()).isEmpty():
            break
        steps, most = written(joined.select("word", F.coalesce("next", "root").alias("root")), "variant-roots"), most - 1
    return steps


def spelling_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, min_count: int = 2, garble: int = 31,
    ratio: int = 10, symbols: int = 6,
) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the vocabulary.

    Near words differ by exactly one code point inserted, deleted or replaced. The form of a word is its near word of
    largest n (ties: the smallest in code-point order) where that is at least `ratio` (more than 1) times its own n,
    else null; the root follows forms to the last. Null and empty texts hold no words; repeated rows count as often as
    they occur; other columns are ignored; an empty table gives no rows.
    """
    words = written(vocabulary(df, id_col, text_col, shortest, min_count, garble), "variant-words")
    near = written(near_words(words, symbols), "variant-pairs")
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    chosen = F.col("form_n") >= F.lit(ratio) * F.col("n")
    rows = rows.select(
        "word", F.when(chosen, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(chosen, F.col("form_n")).alias("form_n"))
    ends = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
