"""Removal of passages that an earlier document holds, by super-k-mer partitioning.

Consecutive windows of k words that share a minimiser travel as one string to the bucket of that minimiser, with the
places where a batch of documents holds it. Equal windows have equal minimisers and so meet in one bucket; there the
windows of all strings of a minimiser are sorted, which finds for every window the smallest document that has it.

A minimiser that would overfill a bucket is known beforehand: its windows travel one by one under their own hashes,
their first documents come from an aggregate that combines before the shuffle, and their places join those back.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics.llm.superkmers import Runs
from clipmetrics.llm.words import slices, text_buffer
from clipmetrics.session import written

PLACE = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("start", "<i4")])
SPANS = "doc_id long, tag long, begin int, until int"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now and not when the driver next collects its garbage.

    Twice, as the first collection only frees what still names them.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows without an id neither hold earlier passages nor lose words. The tag tells texts of one id apart."""
    text = df[text_col].cast("string")
    return df.where(df[id_col].isNotNull()).select(
        df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _batches(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, Runs]]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), Runs(*text_buffer(part.column(2)), k, m)


def frequent_minimisers(docs: DataFrame, k: int, m: int, share: float, least: int) -> np.ndarray:
    """Minimisers of more than 2 * max(share of all runs, least) runs, and none of less than half of that.

    A batch reports the minimisers that have at least `share` of its own runs. Those it leaves out are below that
    share, so the reported sums miss less than `share` of all runs, and no more than 1 / share values pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, runs in _batches(batches, k, m):
            keys, counts = np.unique(runs.keys, return_counts=True)
            often = counts >= max(share * len(runs.keys), 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*keys[often], None], pa.int64()), pa.array([*counts[often], len(runs.keys)], pa.int64())], names=["key", "n"])

    counted = written(docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "minimisers")
    total = counted.where("key is null").agg(F.sum("n")).first()[0] or 0
    found = counted.where(F.col("key").isNotNull() & (F.col("n") >= max(share * total, least))).select("key").collect()
    return np.array([r.key for r in found], dtype=np.int64).view(np.uint64)


def _shipped(k: int, m: int, split: np.ndarray, rounds: int, nth: int, combine: int = 16):
    """key, text, windows, places of the runs of one round, but for the frequent minimisers in split.

    Equal strings of `combine` slices of text are one row with all their places.
    """

    def flush(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(held).sort_by([("key", "ascending"), ("text", "ascending")])
        key, text = rows["key"].combine_chunks(), rows["text"].combine_chunks()
        if not len(key):
            return
        same = pc.and_(pc.equal(key[1:], key[:-1]), pc.equal(text[1:], text[:-1])).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.concatenate([[True], ~same]))
        places = np.empty(len(key), dtype=PLACE)
        for name in PLACE.names:
            places[name] = rows[name].to_numpy()
        ends = np.append(begins, len(key)).astype(np.int32) * PLACE.itemsize
        blobs = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(places.tobytes())])
        take = pa.array(begins)
        out = pa.table([key.take(take), text.take(take), rows["windows"].combine_chunks().take(take), blobs],
                       names=["key", "text", "windows", "places"])
        yield from out.to_batches(max_chunksize=20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for docs, tags, runs in _batches(batches, k, m):
            keys = runs.keys.view(np.uint64)
            runs.select(((keys >> np.uint64(40)) % np.uint64(rounds) == nth) & ~np.isin(keys, split))
            held.append(pa.table({
                "key": runs.keys, "text": pa.array(runs.strings(), pa.binary()), "windows": runs.windows.astype(np.int32),
                "doc": docs[runs.doc], "tag": tags[runs.doc], "start": runs.start.astype(np.int32)}))
            if len(held) == combine:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    return run


def _spans(places: np.ndarray, sizes: np.ndarray, firsts: np.ndarray, at: np.ndarray, k: int) -> pa.RecordBatch:
    """Words to remove: for each place, runs of windows (values of firsts from `at` on) whose first document is smaller."""
    docs, starts = places["doc"], places["start"].astype(np.int64)
    ends = np.cumsum(sizes)
    nth = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes)
    late = firsts[np.repeat(at, sizes) + nth] < np.repeat(docs, sizes)
    opens = late & np.concatenate([[True], ~late[:-1]]) | late & (nth == 0)
    closes = late & np.concatenate([~late[1:], [True]])
    last = np.zeros(len(late), dtype=bool)
    last[ends[sizes > 0] - 1] = True
    closes |= late & last
    place = np.repeat(np.arange(len(docs)), sizes)
    first, final = np.flatnonzero(opens), np.flatnonzero(closes)
    begin = starts[place[first]] + nth[first]
    return pa.RecordBatch.from_arrays([
        pa.array(docs[place[first]], pa.int64()), pa.array(places["tag"][place[first]], pa.int64()), pa.array(begin, pa.int32()),
        pa.array(starts[place[final]] + nth[final] + k, pa.int32()),
    ], names=["doc_id", "tag", "begin", "until"])


def _window_strings(text: bytes, k: int) -> list[bytes]:
    words = text.split(b" ")
    return [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]


def _settled(rows: pa.Table, k: int) -> pa.RecordBatch:
    """Spans from the sorted rows of whole minimisers."""
    key, sizes = rows["key"].to_numpy(), rows["windows"].to_numpy().astype(np.int64)
    blobs = rows["places"].combine_chunks()
    ends = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset:blobs.offset + len(blobs) + 1] // PLACE.itemsize
    places = np.frombuffer(blobs.buffers()[2], PLACE, count=int(ends[-1]))[ends[0]:]
    ends = ends - ends[0]
    low, high = np.minimum.reduceat(places["doc"], ends[:-1]), np.maximum.reduceat(places["doc"], ends[:-1])
    shared = np.zeros(len(key), dtype=bool)
    shared[1:] |= key[1:] == key[:-1]
    shared[:-1] |= shared[1:]
    live = np.flatnonzero(shared | (low < high))
    sizes, low = sizes[live], low[live]
    at = np.cumsum(sizes) - sizes
    firsts = np.repeat(low, sizes)  # right where a minimiser has one string
    texts = rows["text"]
    windows: list[bytes] = []
    numbers: list[int] = []
    for row, i in enumerate(live.tolist()):
        if shared[i]:
            windows += _window_strings(texts[i].as_py(), k)
            numbers += range(int(at[row]), int(at[row] + sizes[row]))
    if windows:
        order = sorted(range(len(windows)), key=windows.__getitem__)
        same = np.fromiter((windows[a] == windows[b] for a, b in zip(order[1:], order)), bool, len(order) - 1)
        begins = np.flatnonzero(np.concatenate([[True], ~same]))
        place = np.array(numbers)[order]
        least = np.minimum.reduceat(firsts[place], begins)
        firsts[place] = np.repeat(least, np.diff(np.append(begins, len(order))))
    counts = np.diff(ends)[live]
    chosen = places[np.repeat(ends[:-1][live] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
    return _spans(chosen, np.repeat(sizes, counts), firsts, np.repeat(at, counts), k)


def _counted(k: int, chunk: int = 1 << 16):
    """Streams rows sorted by (key, text) and settles whole minimisers, about `chunk` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                rows = pa.Table.from_batches(held)
                key = rows["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield _settled(rows.slice(0, cut), k)
                    held, n = rows.slice(cut).to_batches(), len(rows) - cut
        if held:
            yield _settled(pa.Table.from_batches(held), k)

    return run


def _frequent_spans(docs: DataFrame, k: int, m: int, split: np.ndarray, most: int = 65536, salts: int = 64) -> DataFrame:
    """Spans from the windows of frequent minimisers, by aggregate and join on the window's own text.

    Windows of more than `most` places are joined first, each place under one of `salts` copies of the window; the
    others follow, so no key of either join has more than its share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, runs in _batches(batches, k, m):
            runs.select(np.isin(runs.keys.view(np.uint64), split))
            doc, tag, start = ids[runs.doc], tags[runs.doc], runs.start
            windows = [_window_strings(x, k) for x in runs.strings()]
            sizes = np.array([len(w) for w in windows], dtype=np.int64)
            nth = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([
                pa.array([w for ws in windows for w in ws], pa.binary()), pa.array(np.repeat(doc, sizes), pa.int64()),
                pa.array(np.repeat(tag, sizes), pa.int64()), pa.array(np.repeat(start, sizes) + nth, pa.int32())],
                names=["text", "doc_id", "tag", "begin"])

    rows = docs.mapInArrow(run, "text binary, doc_id long, tag long, begin int")
    firsts = written(rows.groupBy("text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "window-firsts")
    hot = firsts.where(F.col("n") > most).select("text", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tag", "begin"), F.lit(salts)).cast("int")).join(hot, ["text", "salt"], "left")
    cold = salted.where("first is null").drop("first").join(firsts.where(F.col("n") <= most), "text")
    spans = ["doc_id", "tag", "begin", (F.col("begin") + k).alias("until")]
    return salted.where("first < doc_id").select(*spans).unionByName(cold.where("first < doc_id").select(*spans))


def repeated_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, m: int = 3, rounds: int = 2,
    share: float = 1 / 16384, least: int = 65536,
) -> DataFrame:
    """doc_id, tag (hash of the text), begin, until: word ranges that lie in a window of k words which a document of a smaller id holds too.

    Ranges may touch or overlap. Minimisers are handled in `rounds` shares, so that shuffle files of one share are
    gone before the next; a minimiser of more than max(share of all runs, least) runs is split by window.
    """
    docs = _documents(df, id_col, text_col)
    split = frequent_minimisers(docs, k, m, share, least)
    found = []
    for nth in range(rounds):
        shipped = docs.mapInArrow(_shipped(k, m, split, rounds, nth), "key long, text binary, windows int, places binary")
        sorted_rows = shipped.repartition("key").sortWithinPartitions("key", "text")
        found.append(written(sorted_rows.mapInArrow(_counted(k), SPANS), f"spans-{nth}"))
        del shipped, sorted_rows
        release(df.sparkSession)
    if len(split):
        found.append(written(_frequent_spans(docs, k, m, split), "spans-frequent"))
        release(df.sparkSession)
    spans = found[0]
    for other in found[1:]:
        spans = spans.unionByName(other)
    return spans


def _covered(n: int, spans: list) -> np.ndarray:
    change = np.zeros(n + 1, dtype=np.int64)
    for begin, until in spans:
        if begin < n:
            change[begin] += 1
            change[min(until, n)] -= 1
    return np.cumsum(change)[:n] > 0


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_removed, kept (the kept words joined by a space), kept_sha256.

    Windows are judged on the input. Null and empty texts have no words. A row without an id keeps all its words and
    takes none from others. Nothing is taken from one row for another of its id, and each loses only what its own
    windows cover. Texts shorter than a window keep everything; an empty table gives no rows;
    other columns are ignored.
    """
    ranges = (
        repeated_spans(df, id_col, text_col, **parameters)
        .groupBy(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag")).agg(F.collect_set(F.struct("begin", "until")).alias("spans"))
    )
    text = df[text_col].cast("string")
    texts = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    joined_rows = texts.join(ranges, (F.col("doc_id") == F.col("of")) & (F.col("tag") == F.col("of_tag")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                rows = []
                for doc_id, text, spans in zip(*(c.to_pylist() for c in part.columns)):
                    words = (text or "").encode().split()
                    gone = _covered(len(words), [(s["begin"], s["until"]) for s in spans or ()])
                    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                    rows.append((doc_id, len(words), int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
                columns = zip(*rows) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return joined_rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
