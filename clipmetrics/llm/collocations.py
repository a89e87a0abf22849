"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: the word at a place and the lead words after it, padded with nulls where the
piece ends. One ROLLUP over these columns sums the counts of ever shorter prefixes, which are the counts of all
shorter phrases, and at its last level the number of words of a language; no phrase length is counted by itself.

A window is also padded from where no phrase can reach `min_count`. Tables of fixed size hold, for hashed phrases
of one to five words, how often their bucket occurs; a bucket below min_count holds no phrase that reaches it, so
no occurrence of a frequent phrase is cut. A bucket that is full by chance costs time only; a corpus of very many words
fills all of them, and then windows are as long as their pieces let them be.

Almost every task meets almost every frequent window. So a task sends its counts in few rows, each with all windows of one
hash value, and they become rows of their own only after those of all tasks have been added up.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmetrics.llm.superkmers import word_hashes
from clipmetrics.llm.words import joined, slices, text_buffer
from clipmetrics.session import written

ORDER = 5
BLOCK = 1 << 16
HELD = 300_000  # windows that a task counts at a time
PARTS = 256  # of a language's windows, by hash
LANGUAGES = 10_000  # no more than this many rows of word totals are broadcast
BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of the texts of a batch, lower-cased, and for each how many words its piece still holds from it on."""

    def __init__(self, column: pa.Array) -> None:
        data, offsets = text_buffer(column)
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        ink = ~GAP[data]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        begins = ink.copy()
        begins[1:] &= ~ink[:-1]
        begins[inner] = ink[inner]
        ends = ink.copy()
        ends[:-1] &= ~ink[1:]
        last = inner[inner > 0] - 1
        ends[last] = ink[last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.data, self.first = data, np.searchsorted(self.starts, offsets)
        # A piece is a run of words of one text without a breaking byte between them.
        breaks = np.concatenate([[0], np.cumsum(BREAK[data], dtype=np.int64)])[self.starts]
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        n = len(self.starts)
        new = np.ones(n, dtype=bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
        piece_starts = np.append(np.flatnonzero(new), n)
        self.left = piece_starts[np.cumsum(new)] - np.arange(n) if n else np.zeros(0, dtype=np.int64)

    def buckets(self, bits: int, langs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For phrases of 1 to 5 words: the places that have one, and its bucket; all tables lie one after the other."""
        word = word_hashes(self.data, self.starts, self.ends)
        own = np.array([crc32(x.encode()) for x in langs], dtype=np.uint64) * MIX
        word += np.repeat(own, np.diff(self.first))  # the same word of two languages is two words
        hashed = np.zeros(len(word), dtype=np.uint64)
        for order in range(1, ORDER + 1):
            n = max(len(word) - order + 1, 0)
            hashed = (hashed[:n] ^ (hashed[:n] >> np.uint64(29))) * MIX + word[order - 1:]
            at = np.flatnonzero(self.left[:n] >= order)
            mixed = (hashed[at] ^ (hashed[at] >> np.uint64(32))) * MIX
            yield at, (order - 1 << bits) + (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def lengths(self, often: np.ndarray, bits: int, langs: list[str]) -> np.ndarray:
        """How many words the window at every place may hold; 0 where not even its first word is frequent."""
        reach = np.minimum(self.left, ORDER)
        for shorter, (at, bucket) in enumerate(self.buckets(bits, langs)):
            seldom = at[often[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1 == 0]
            reach[seldom] = np.minimum(reach[seldom], shorter)
        # What follows the first word of a frequent phrase is a frequent phrase as well.
        for _ in range(ORDER - 1):
            reach[:-1] = np.minimum(reach[:-1], np.where(self.left[:-1] > 1, reach[1:] + 1, reach[:-1]))
        return reach


def _texts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.select(
        df[text_col].cast("string").alias("text"), F.coalesce(df[lang_col].cast("string"), F.lit("und")).alias("lang"))


def frequent_buckets(texts: DataFrame, min_count: int, bits: int) -> np.ndarray:
    """A bit for every bucket of the five tables: whether its phrases occur min_count times together.

    Tasks send their counters, cut off at 255 (or at 65535 where min_count is beyond that), block by block; each block is
    added up by one streaming task and comes back as bits, 2^bits / 8 bytes a table in all, whatever the size of the corpus.
    """
    kind = np.dtype("u1" if min_count <= 255 else "<u2")
    if min_count > np.iinfo(kind).max:
        return np.full(max((ORDER << bits) // 8, 1), 255, dtype=np.uint8)
    most, size = int(np.iinfo(kind).max), min(BLOCK, 1 << bits)
    blocks = (ORDER << bits) // size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(ORDER << bits, dtype=kind)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for _, bucket in Words(part.column(0)).buckets(bits, part.column(1).to_pylist()):
                    values, n = np.unique(bucket, return_counts=True)
                    table[values] = np.minimum(table[values] + n, most)
        for number, part in enumerate(table.reshape(blocks, size)):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = -1, np.zeros(size, dtype=np.int64)

        def full() -> pa.RecordBatch:
            bits_of = np.packbits(total >= min_count, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([bits_of], pa.binary())], names=["block", "often"])

        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != number and number >= 0:
                    yield full()
                    total[:] = 0
                number = block
                total += np.frombuffer(counts.as_buffer(), kind)
        if number >= 0:
            yield full()

    counted = texts.mapInArrow(count, "block long, counts binary")
    summed = counted.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, often binary")
    often = np.zeros((blocks, -(-size // 8)), dtype=np.uint8)
    for block, flags in summed.toArrow().to_pandas().itertuples(index=False):
        often[block] = np.frombuffer(flags, np.uint8)
    return often.ravel()


NAMES = ["lang", *[f"w{k}" for k in range(1, ORDER + 1)], "n"]
Counts = dict[str, Counter]


def _rows(lang: str, counts: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """One row per window, padded with nulls."""
    found = list(counts.items())
    for low in range(0, len(found), 20_000):
        part = found[low:low + 20_000]
        columns = zip(*((lang, *(window.decode().split(" ") if window else ()), *(None,) * ORDER)[:ORDER + 1] for window, _ in part))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.string()) for c in columns), pa.array([n for _, n in part], pa.int64())], names=NAMES)


def _parts(lang: str, counts: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """One row for all windows of a hash value, line by line, and their counts."""
    found, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
    part = np.fromiter(map(crc32, found), np.int64, len(found)) % PARTS
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist()
    for low, high in zip(cuts, [*cuts[1:], len(found)]):
        at = order[low:high]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.array([part[at[0]]], pa.int64()),
             pa.array([b"\n".join([found[i] for i in at.tolist()])], pa.binary()), pa.array([n[at].tobytes()], pa.binary())],
            names=["lang", "part", "windows", "counts"])


def _emptied(counts: Counts, out: Callable[[str, dict[bytes, int]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """The less frequent half of the windows leaves, those that come again and again stay."""
    edge = np.median(np.fromiter((n for c in counts.values() for n in c.values()), np.int64))
    for lang, own in list(counts.items()):
        kept = Counter({w: n for w, n in own.items() if n > edge})
        yield from out(lang, {w: n for w, n in own.items() if n <= edge})
        counts[lang] = kept
        if not kept:
            del counts[lang]


def counted_windows(texts: DataFrame, often: np.ndarray, bits: int) -> DataFrame:
    """The longest windows that each task counts, batch by batch: lang, part (a hash of the window), windows and counts.

    A window of no word stands for words that no frequent phrase begins with. Rows grow with the tasks, not with the
    windows: a task has one for each part of a language, and a further one each time it holds too many.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counts = defaultdict(Counter)
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                words = Words(part.column(0))
                reach = words.lengths(often, bits, part.column(1).to_pylist())
                data, starts, ends = joined(words.data, words.starts, words.ends)
                data = data.tobytes()
                at = np.flatnonzero(reach)
                until = ends[at + reach[at] - 1]
                codes = part.column(1).dictionary_encode()
                langs = codes.dictionary.to_pylist()
                text = np.repeat(np.arange(part.num_rows), np.diff(words.first))
                code = codes.indices.to_numpy()[text] if len(text) else np.zeros(0, np.int64)
                # All words of a language in turn; texts of many languages in one slice only make more, shorter turns.
                order = np.argsort(code[at], kind="stable")
                cuts = np.searchsorted(code[at][order], np.arange(len(langs) + 1))
                idle = np.bincount(code[reach == 0], minlength=len(langs))
                begins, stops = starts[at][order].tolist(), until[order].tolist()
                for number, lang in enumerate(langs):
                    low, high = int(cuts[number]), int(cuts[number + 1])
                    counts[lang].update([data[b:e] for b, e in zip(begins[low:high], stops[low:high])])
                    if idle[number]:
                        counts[lang][b""] += int(idle[number])
                if sum(map(len, counts.values())) > HELD:
                    yield from _emptied(counts, _parts)
        for lang, own in counts.items():
            yield from _parts(lang, own)

    return texts.mapInArrow(run, "lang string, part long, windows binary, counts binary")


def windows(texts: DataFrame, often: np.ndarray, bits: int) -> DataFrame:
    """lang, w1 to w5 and n: the longest windows, padded with nulls, added up over all tasks part by part.

    A part that outgrows its task comes out in pieces, so a window may still come more than once.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counts = defaultdict(Counter)
        last = None
        for batch in batches:
            for lang, part, found, n in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), batch.column(3)):
                if (lang, part) != last:
                    for x, own in counts.items():
                        yield from _rows(x, own)
                    counts.clear()
                    last = lang, part
                own = counts[lang]
                for window, times in zip(found.as_py().split(b"\n"), np.frombuffer(n.as_buffer(), np.int64).tolist()):
                    own[window] += times
                if len(own) > HELD:
                    yield from _emptied(counts, _rows)
        for lang, own in counts.items():
            yield from _rows(lang, own)

    dealt = counted_windows(texts, often, bits).repartition("lang", "part").sortWithinPartitions("lang", "part")
    return dealt.mapInArrow(add, ", ".join(f"{c} string" for c in NAMES[:-1]) + ", n long")


def phrase_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, bits: int = 23) -> DataFrame:
    """lang, words (array), size and f of every phrase of 1 to 5 words with f >= min_count; size 0 holds the number of words.

    Counts of phrases that occur less often are not complete and are left out.
    """
    texts = _texts(df, text_col, lang_col)
    columns = [f"w{k}" for k in range(1, ORDER + 1)]
    longest = windows(texts, frequent_buckets(texts, min_count, bits), bits).groupBy("lang", *columns).agg(F.sum("n").alias("n"))
    summed = longest.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("above"))
    # Level k keeps the first k words and rolls up the rest; a padded word is a null that is not rolled up.
    size = sum(F.when(F.col("above") < (1 << ORDER - k), 1).otherwise(0) for k in range(1, ORDER + 1))
    last = F.coalesce(*[F.when(F.col("size") == k, F.col(f"w{k}")) for k in range(1, ORDER + 1)])
    return (
        summed.withColumn("size", size)
        .where((F.col("above") < 1 << ORDER) & ((F.col("size") == 0) | (last.isNotNull() & (F.col("f") >= min_count))))
        .select("lang", F.slice(F.array(*columns), 1, F.col("size")).alias("words"), "size", "f")
    )


def _wide(number: Column) -> Column:
    return number.cast("decimal(20,0)")


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, absorb_percent: int = 100,
    top: int = 2000, bits: int = 23,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` first phrases of 2 to 5 words of every language.

    Texts are lower-cased in A-Z and split at `.,;:!?` and line breaks into pieces, pieces at spaces and tabs into words.
    The score of a cut is floor(1000 * a * n / (l * r)), exact up to 10^17 words; the lowest cut counts, ties to the
    smallest. A phrase goes where a longer one that holds it occurs at least absorb_percent as often (100 or less).
    A null text is empty, a null language is `und`; other columns, also of the names used here, are ignored. Repeated
    rows count as often as they occur. Ties in score and a go to the smaller phrase in UTF-8 order. An empty table gives no rows.
    """
    counts = written(phrase_counts(df, text_col, lang_col, min_count, bits), "phrase-counts")
    phrase = F.array_join("words", " ")
    known = counts.where("size > 0").select("lang", phrase.alias("part"), "f")
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    if total.limit(LANGUAGES + 1).count() <= LANGUAGES:
        total = F.broadcast(total)
    wanted = counts.where("size > 1").select("lang", "words", phrase.alias("phrase"), "size", F.col("f").alias("a"))
    cut = wanted.select(
        "lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "words", "size",
    ).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"))
    heads, tails = (known.select(F.col("lang").alias(f"{x}_lang"), F.col("part").alias(x), F.col("f").alias(f)) for x, f in (("head", "l"), ("tail", "r")))
    scored = (
        cut.join(heads.withColumnRenamed("head", "h"), (F.col("lang") == F.col("head_lang")) & (F.col("head") == F.col("h")))
        .join(tails.withColumnRenamed("tail", "t"), (F.col("lang") == F.col("tail_lang")) & (F.col("tail") == F.col("t")))
        .join(total, "lang")
        .withColumn("numerator", _wide(F.col("a")) * _wide(F.col("n")) * F.lit(1000).cast("decimal(4,0)"))
        .withColumn("denominator", _wide(F.col("l")) * _wide(F.col("r")))
        .withColumn("score", F.expr("numerator div denominator"))
        .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    )
    # A phrase lies inside one of one word more that is as frequent as any longer one around it.
    longer = wanted.where("size > 2").select(
        F.col("lang").alias("in_lang"), F.col("a").alias("f"),
        F.explode(F.array(*[F.array_join(F.slice("words", at, F.col("size") - 1), " ") for at in (1, 2)])).alias("inside"))
    longer = longer.groupBy("in_lang", "inside").agg(F.max("f").alias("f"))
    kept = scored.join(
        longer, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inside"))
        & (F.lit(100) * F.col("f") >= F.lit(absorb_percent) * F.col("a")), "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
