"""Packing of related documents: a sharded BM25 index offers unused neighbours, which greedily fill each window.

Term statistics cover all documents. Shards are made by content: the BM25 vectors, projected to few dimensions, are cut
in two along their widest direction again and again, at quantiles of a sample chosen by hash, until a shard is of
bounded size. Neighbours come from the same shard. Neither shards nor results depend on how the input was split, and
copies, however many, are dealt to several shards by a hash of row content where they do not fit one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from functools import lru_cache, partial
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmetrics.llm import tokens
from clipmetrics.llm.words import slices
from clipmetrics.session import written

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
K1, B = 1.2, 0.75
FULL = 10  # weights of terms held by more than one in so many entries are added up last
WIDE = 40  # and terms held by more than one in so many have full columns
BLOCK, READY = 128, 24 << 20  # documents whose sums are made at a time, and bytes of sums that wait to be asked for
DIMENSIONS = 64
BASE, SAMPLE = 16384, 32  # documents in all, and further ones a shard, that are looked at to place the cuts


class Statistics(NamedTuple):
    """Number of documents, their mean length in ids, and for every term how many hold it."""

    docs: float
    mean: float
    df: np.ndarray


def weights(stats: Statistics, terms: np.ndarray, often: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """BM25 weight of terms that documents of these lengths hold so often."""
    df = stats.df[terms]
    idf = np.log1p((stats.docs - df + 0.5) / (df + 0.5))
    return idf * often * (K1 + 1) / (often + K1 * (1 - B + B * lengths / max(stats.mean, 1)))


class Terms(NamedTuple):
    """Distinct ids of a document without its last one, how often it holds each, and its length."""

    terms: np.ndarray
    often: np.ndarray
    length: int


def counted(ids: list[np.ndarray]) -> list[Terms]:
    """The terms of documents, sorted all at once by document and id."""
    sizes = np.array([len(row) - 1 for row in ids], dtype=np.int64)
    held = np.concatenate([*(row[:-1] for row in ids), np.zeros(0, np.uint16)])
    bits = max(int(held.max(initial=0)).bit_length(), 1)
    kind = np.uint32 if len(ids) << bits <= 1 << 32 else np.uint64
    keys = np.repeat(np.arange(len(ids), dtype=kind) << kind(bits), sizes) | held.astype(kind)
    keys.sort()
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]), len(keys) - 1) + 1 if len(keys) else np.zeros(0, np.int64)
    often, keys = np.diff(ends, prepend=0), keys[ends - 1]
    terms = (keys & kind((1 << bits) - 1)).astype(np.uint16 if bits <= 16 else np.uint32)
    cuts = np.searchsorted(ends, np.cumsum(sizes), side="right").tolist()
    return [Terms(terms[a:b], often[a:b], len(row)) for a, b, row in zip([0, *cuts], cuts, ids)]


class Bm25:
    """Inverted index over the token ids of one shard's distinct documents, each as often as `copies` says.

    Without `stats` these documents are all there are. Every term counts. Postings of terms that a tenth of the entries
    hold are kept as full columns of half the width: their sums say which entries to score exactly.
    """

    def __init__(self, found: list[Terms], copies: np.ndarray | None = None, stats: Statistics | None = None) -> None:
        copies = np.ones(len(found)) if copies is None else copies.astype(np.float64)
        self.sizes = np.array([len(f.terms) for f in found], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        docs = np.repeat(np.arange(len(found)), self.sizes)
        self.terms = np.concatenate([*(f.terms for f in found), np.zeros(0, np.uint16)]).astype(np.int64)
        often = np.concatenate([*(f.often for f in found), np.zeros(0, np.int64)]).astype(np.float64)
        lengths = np.array([f.length for f in found], dtype=np.float64)
        if stats is None:
            mean = np.average(lengths, weights=copies) if len(found) else 1
            stats = Statistics(copies.sum(), mean, np.bincount(self.terms, weights=copies[docs], minlength=1))
        self.weights = weights(stats, self.terms, often, lengths[docs])
        self.asked = np.zeros(int(self.terms.max(initial=0)) + 1, dtype=bool)
        self.ready: dict[int, np.ndarray] = {}
        order = np.argsort(self.terms.astype(np.uint16) if len(self.asked) <= 1 << 16 else self.terms, kind="stable")
        self._index(np.arange(len(found)), docs[order], self.terms[order], self.weights[order])

    def _index(self, entries: np.ndarray, docs: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> None:
        """Postings in the order of terms, over the entries that are still of use."""
        self.entries, self.n = entries, len(entries)
        self.docs, self.of, self.weight = docs, terms, weight
        self.held = np.bincount(terms, minlength=len(self.asked))
        self.ends = np.cumsum(self.held)
        self.full = self.held * FULL > self.n
        self.wide = self.held * WIDE > self.n
        self.row = np.cumsum(self.wide) - 1
        self.columns = np.zeros((int(self.wide.sum()), self.n), dtype=np.float32)
        posted = self.wide[terms]
        self.columns[self.row[terms[posted]], docs[posted]] = weight[posted]

    def keep(self, useful: np.ndarray) -> None:
        """Drop the postings of entries that no one can take any more; scores of the others stay as they are."""
        stay = useful[self.entries]
        place = np.cumsum(stay) - 1
        live = stay[self.docs]
        self.ready = {doc: sums[stay] for doc, sums in self.ready.items()}
        self._index(self.entries[stay], place[self.docs[live]], self.of[live], self.weight[live])

    def own(self, doc: int) -> np.ndarray:
        return self.terms[self.starts[doc]:self.starts[doc] + self.sizes[doc]]

    def about(self, doc: int, useful: np.ndarray) -> tuple[np.ndarray, float]:
        """BM25 of every kept entry, in the order of `entries`, for the terms of one, and how far a sum may be off.

        The sums for those most like it are made along with it, in one product, as they are likely to be asked for next.
        """
        out = self.ready.pop(doc, None)
        if out is None:
            out = self._rare(doc)
            for row in self.row[self.own(doc)[self.wide[self.own(doc)]]].tolist():
                out += self.columns[row]
            if (len(self.ready) + BLOCK) * out.nbytes > READY:
                self.ready = {d: sums for d, sums in self.ready.items() if useful[d]}
            room = min(READY // max(out.nbytes, 1) - len(self.ready), BLOCK)
            likely = np.argsort(-out, kind="stable")[:4 * BLOCK] if room > 0 else np.zeros(0, np.int64)
            likely = [d for d in self.entries[likely].tolist() if useful[d] and d not in self.ready][:max(room, 0)]
            asked = np.zeros((len(likely), len(self.columns)), dtype=np.float32)
            for sums, d in zip(asked, likely):
                sums[self.row[self.own(d)[self.wide[self.own(d)]]]] = 1
            for sums, d in zip(asked @ self.columns, likely):
                self.ready[d] = self._rare(d) + sums
        return out, (len(self.columns) + len(self.own(doc)) + 4) * 2.0 ** -23 * float(out.max(initial=0))

    def _rare(self, doc: int) -> np.ndarray:
        """Sums over the postings of the terms that have no full columns."""
        rare = self.own(doc)[~self.wide[self.own(doc)]]
        parts = [slice(a, b) for a, b in zip((self.ends[rare] - self.held[rare]).tolist(), self.ends[rare].tolist()) if a < b]
        if not parts:
            return np.zeros(self.n, dtype=np.float32)
        return np.bincount(
            np.concatenate([self.docs[p] for p in parts]), np.concatenate([self.weight[p] for p in parts]),
            minlength=self.n).astype(np.float32)

    def scores(self, doc: int, at: np.ndarray) -> np.ndarray:
        """BM25 of the kept entries at these places, in double precision: rare terms first, each kind in its order."""
        entries = self.entries[at]
        sizes = self.sizes[entries]
        place = np.repeat(self.starts[entries] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        self.asked[self.own(doc)] = True
        hit = self.asked[self.terms[place]]
        self.asked[self.own(doc)] = False
        owner, place = np.repeat(np.arange(len(at)), sizes)[hit], place[hit]
        full, weight = self.full[self.terms[place]], self.weights[place]
        out = np.bincount(owner[~full], weight[~full], minlength=len(at)).astype(np.float64)
        np.add.at(out, owner[full], weight[full])
        return out


def runs(
    scores: np.ndarray, size: int = 16, exact: Callable[[np.ndarray], np.ndarray] | None = None, slack: float = 0.0,
) -> Iterator[np.ndarray]:
    """Places of positive scores, best first, those of equal score together; sorted only as far as they are asked for.

    Scores that may be off by `slack` choose the places whose `exact` scores are asked for and count.
    """
    rest = np.flatnonzero(scores > 0)
    while len(rest):
        top, edge = rest, 0.0
        if len(rest) > size:
            near = scores[rest]
            edge = float(np.partition(near, len(near) - size)[len(near) - size]) - slack
            above = near >= edge - slack
            top, rest = rest[above], rest[~above]
        else:
            rest = rest[:0]
        own = scores[top] if exact is None else exact(top)
        sure = own >= edge  # what is left behind is below
        top, own, rest = top[sure], own[sure], np.append(rest, top[~sure])
        order = np.argsort(-own, kind="stable")
        top, own, low = top[order], own[order].tolist(), 0
        while low < len(own):
            high = low + 1
            while high < len(own) and own[high] == own[low]:
                high += 1
            yield top[low:high]
            low = high
        size *= 4


def windows(
    ids: list[np.ndarray], window: int, stats: Statistics | None = None, found: list[Terms] | None = None,
) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document number, start, length), each full but for the last ones, which are powers of two.

    The first unused document seeds a window; its best unused neighbours by BM25 follow, ties to the first, and after
    those with no common term the next unused document. Equal documents are one entry of the index. The one that meets the end is cut and seeds the next window.
    """
    members: dict[bytes, list[int]] = {}
    for number, row in enumerate(ids):
        members.setdefault(row.tobytes(), []).append(number)
    groups = [m[::-1] for m in members.values()]
    group = np.empty(len(ids), dtype=np.int64)
    for g, m in enumerate(groups):
        group[m] = g
    members.clear()
    heads = [m[-1] for m in groups]
    index = Bm25([found[h] for h in heads] if found else counted([ids[h] for h in heads]), np.array([len(m) for m in groups]), stats)
    free_groups = np.ones(len(groups), dtype=bool)
    upcoming = np.array(heads, dtype=np.int64)
    unused = np.ones(len(ids), dtype=bool)
    first = taken = 0
    segments: list[tuple[int, int, int]] = []
    room, ranked, ties, seed = window, None, [], -1
    while True:
        if seed < 0:
            while first < len(ids) and not unused[first]:
                first += 1
            if first == len(ids):
                break
            seed, ranked, number = first, None, first
        else:
            if ranked is None:
                if taken * 4 > index.n:
                    index.keep(free_groups)
                    taken = 0
                scores, slack = index.about(int(group[seed]), free_groups)
                scores[~free_groups[index.entries]] = 0
                ranked, ties = runs(scores, 4, partial(index.scores, group[seed]), slack), []
            if not ties:
                ties = [(int(upcoming[g]), int(g)) for g in index.entries[next(ranked, np.zeros(0, np.int64))]]
                heapify(ties)
            if not ties:
                seed = -1
                continue
            number = heappop(ties)[1]
            number = int(upcoming[number])
        unused[number] = False
        own = int(group[number])
        members_left = groups[own]
        members_left.pop()
        if members_left:
            upcoming[own] = members_left[-1]
            if ranked is not None:
                heappush(ties, (members_left[-1], own))
        else:
            free_groups[own] = False
            taken += 1
        start, left = 0, len(ids[number])
        while left:
            length = min(left, room)
            segments.append((number, start, length))
            start, left, room = start + length, left - length, room - length
            if not room:
                yield segments
                segments, room = [], window
                seed, ranked = (number, None) if left else (-1, None)
    # What is left over is dealt to sequences of a power of two, which need no padding.
    left = window - room
    size = 1 << max(left.bit_length() - 1, 0)
    part: list[tuple[int, int, int]] = []
    free = size
    for number, start, length in segments:
        while length:
            take = min(length, free)
            part.append((number, start, take))
            start, length, free, left = start + take, length - take, free - take, left - take
            if not free:
                yield part
                part, free = [], 1 << max(left.bit_length() - 1, 0)


def statistics(encoded: DataFrame) -> tuple[Statistics, int]:
    """Term statistics of all documents and the sum of their sizes: one row per term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, totals = np.zeros(1, dtype=np.int64), np.zeros(3, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "terms", 1 << 20):
                held = np.bincount(np.concatenate(_numbers(part.column(0), part.column(2))).astype(np.int64))
                df, held = (np.pad(x, (0, max(len(df), len(held)) - len(x))) for x in (df, held))
                df += held
                totals += (part.num_rows, *(np.sum(part.column(i).to_numpy(), dtype=np.int64) for i in (3, 1)))
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(terms, (-1, -2, -3))), pa.array(np.append(df[terms], totals))], names=["term", "n"])

    rows = encoded.select("terms", "size", "n_terms", "n_ids").mapInArrow(run, "term long, n long")
    counts = rows.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = counts["term"].to_numpy(), counts["n"].to_numpy()
    docs, ids, size = (int(n[term == t].sum()) for t in (-1, -2, -3))
    df = np.zeros(max(int(term.max(initial=0)), 0) + 1)
    df[term[term >= 0]] = n[term >= 0]
    return Statistics(docs, ids / max(docs, 1), df), size


@lru_cache(maxsize=1)
def _directions(terms: int) -> np.ndarray:
    return np.random.default_rng(1).standard_normal((terms, DIMENSIONS), dtype=np.float32)


def vectors(found: list[Terms], stats: Statistics) -> np.ndarray:
    """Directions of the BM25 vectors, projected at random."""
    out = np.zeros((len(found), DIMENSIONS), dtype=np.float32)
    to = _directions(len(stats.df))
    for i, row in enumerate(found):
        if len(row.terms):
            vector = weights(stats, row.terms, row.often, np.float64(row.length)).astype(np.float32) @ to[row.terms]
            out[i] = vector / max(float(np.sqrt((vector * vector).sum())), 1e-12)
    return out


def _along(x: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Row by row in one order of summing, so that equal rows and the cut made at one of them agree to the last bit."""
    return np.ascontiguousarray(x.astype(np.float64) * axis).sum(axis=1)


class Tree(NamedTuple):
    """Cuts in two: rows beyond (cut, tie) along the axis go to the second child. A negative child -1 - n is shard n."""

    axes: np.ndarray
    cuts: np.ndarray
    ties: np.ndarray
    children: np.ndarray

    def shards(self, x: np.ndarray, tie: np.ndarray) -> np.ndarray:
        at = np.full(len(x), 0 if len(self.cuts) else -1, dtype=np.int64)
        while len(live := np.flatnonzero(at >= 0)):
            node = at[live]
            place = _along(x[live], self.axes[node])
            beyond = (place > self.cuts[node]) | ((place == self.cuts[node]) & (tie[live] > self.ties[node]))
            at[live] = self.children[node, beyond.astype(np.int64)]
        return -1 - at


def tree(x: np.ndarray, tie: np.ndarray, size: np.ndarray, shards: int) -> Tree:
    """Cut a sample into shards of equal size, each time along the direction in which its vectors differ most."""
    axes, cuts, ties, children = [], [], [], []
    todo = [(np.lexsort((size, tie, *x.T)), shards, 0, -1, 0)] if shards > 1 else []
    while todo:
        rows, n, shard, parent, side = todo.pop()
        if parent >= 0:
            children[parent][side] = len(axes) if n > 1 else -1 - shard
        if n == 1:
            continue
        centred = x[rows].astype(np.float64) - (x[rows].mean(axis=0, dtype=np.float64) if len(rows) else 0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        axis = axis * (1 if axis[np.abs(axis).argmax()] > 0 else -1)
        place = _along(x[rows], axis)
        order = np.lexsort((tie[rows], place))
        rows, place = rows[order], place[order]
        until = np.cumsum(size[rows])
        first = int(np.searchsorted(until, until[-1] * (n // 2) / n)) if len(rows) else 0
        first = min(first, len(rows) - 1)
        cuts.append(place[first] if len(rows) else 0.0)
        ties.append(tie[rows[first]] if len(rows) else 0)
        number = len(axes)
        axes.append(axis)
        children.append([0, 0])
        todo += [(rows[:first + 1], n // 2, shard, number, 0), (rows[first + 1:], n - n // 2, shard + n // 2, number, 1)]
    return Tree(np.array(axes).reshape(-1, DIMENSIONS), np.array(cuts), np.array(ties, dtype=np.int64), np.array(children, dtype=np.int64).reshape(-1, 2))


def _numbers(column: pa.Array, sizes: pa.Array) -> list[np.ndarray]:
    """Arrays of unsigned numbers, of 2 or 4 bytes as their sizes tell."""
    return [
        np.frombuffer(row.as_buffer(), "<u2" if len(row.as_buffer()) == 2 * n else "<u4") if n else np.zeros(0, "<u2")
        for row, n in zip(column, sizes.to_pylist())]


def _terms(terms: pa.Array, often: pa.Array, n_terms: pa.Array, n_ids: pa.Array) -> list[Terms]:
    return [Terms(*row) for row in zip(_numbers(terms, n_terms), _numbers(often, n_terms), n_ids.to_pylist())]


def _narrow(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u2" if numbers.max(initial=0) < 1 << 16 else "<u4").tobytes()


IDS = ["doc_id", "size", "ids", "terms", "often", "n_terms", "n_ids"]
ENCODED = "doc_id long, size long, ids binary, terms binary, often binary, n_terms long, n_ids long"


def sharded(encoded: DataFrame, stats: Statistics, size: int, batch_bytes: int) -> DataFrame:
    """encoded with its shard, each shard whole in one task and in the order of doc_id."""
    spark, count = encoded.sparkSession, max(ceil(size / batch_bytes), 1)
    rows = encoded.withColumn("tie", F.xxhash64(F.lit(7), "doc_id", "ids"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.encoder.cache_clear()
        for batch in batches:
            for part in slices(batch, "terms", 1 << 20):
                x = vectors(_terms(*part.columns[2:]), stats)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([v.tobytes() for v in x], pa.binary())], names=["size", "tie", "x"])

    cut = Tree(np.zeros((0, DIMENSIONS)), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
    if count > 1:
        share = min((BASE + SAMPLE * count) / stats.docs, 1.0)
        sample = rows.where(F.pmod(F.xxhash64(F.lit(11), "doc_id", "ids"), F.lit(1 << 30)) < int(share * (1 << 30)))
        seen = sample.select("size", "tie", "terms", "often", "n_terms", "n_ids").mapInArrow(project, "size long, tie long, x binary").toArrow()
        x = np.frombuffer(b"".join(seen["x"].to_pylist()), np.float32).reshape(-1, DIMENSIONS)
        cut = tree(x, seen["tie"].to_numpy(), seen["size"].to_numpy(), count)
    # A number for each shard that the exchange deals to a partition of its own.
    numbers = spark.range(64 * count).groupBy(F.pmod(F.hash("id"), F.lit(count)).alias("p")).agg(F.min("id").alias("slot")).orderBy("p").collect()
    slots = np.resize(np.array([r.slot for r in numbers], dtype=np.int64), count)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.encoder.cache_clear()
        for batch in batches:
            for part in slices(batch, "ids", 1 << 20):
                shard = cut.shards(vectors(_terms(*part.columns[3:7]), stats), part.column(7).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(shard), pa.array(slots[shard])], names=[*IDS, "tie", "shard", "slot"])

    routed = rows.select(*IDS, "tie").mapInArrow(route, f"{ENCODED}, tie long, shard long, slot long")
    return routed.repartition(count, "slot").sortWithinPartitions("shard", "doc_id", "tie")


def pack_lexical(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, path: str | None = None,
    batch_bytes: int = 12 << 20,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (uint32), doc_tokens, sequence_id, offset.

    Every id of every document, with its closing id 0, lies in exactly one piece; pieces of a sequence follow each
    other without a gap from offset 0. Sequences have `window` ids; the few at the end of a shard have a power of two.
    Null and empty texts are one closing id; null doc_ids stay null; repeated rows are packed each; ties go to the
    smaller doc_id; an empty table gives no rows; other columns are ignored. A shard has about batch_bytes of text; one
    of more than twice that is cut in the order of doc_id, and a longer text forms a shard of its own. Rows equal in
    doc_id and text stay in one task. sequence_id counts within the shard, whose number is in its upper bits.
    """
    path = path or tokens.default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids = [tokens.token_ids(t, path) for t in part.column(1).to_pylist()]
                found = counted(ids)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array([_narrow(row) for row in ids], pa.binary()),
                    pa.array([_narrow(f.terms) for f in found], pa.binary()), pa.array([_narrow(f.often) for f in found], pa.binary()),
                    pa.array([len(f.terms) for f in found], pa.int64()), pa.array([f.length for f in found], pa.int64())], names=IDS)

    text = df[text_col].cast("string")
    encoded = written(
        df.select(df[id_col].cast("long").alias("doc_id"), text.alias("text"),
                  (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"))
        .mapInArrow(encode, ENCODED), "lexical-ids")
    stats, size = statistics(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.encoder.cache_clear()
        last, number = None, 0
        for shard, doc_ids, ids, found in _whole(batches, 2 * batch_bytes):
            last, number = shard, number if shard == last else 0
            rows: list[tuple] = []
            for segments in windows(ids, window, stats, found):
                offset = 0
                for at, start, length in segments:
                    piece = ids[at][start:start + length].astype("<u4").tobytes()
                    rows.append((doc_ids[at], start, length, piece, len(ids[at]), shard << 40 | number, offset))
                    offset += length
                number += 1
                if len(rows) >= 2048:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    packed = sharded(encoded, stats, size, batch_bytes).select("shard", *IDS)
    return packed.mapInArrow(run, SCHEMA)


def _whole(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[int | None], list[np.ndarray], list[Terms]]]:
    """Shard number, doc_ids, ids and terms of one shard after the other; what exceeds `most` follows as a further one."""
    last, held, doc_ids, ids, found = -1, 0, [], [], []
    for batch in batches:
        shards, numbers, sizes = (batch.column(i).to_pylist() for i in range(3))
        rows = _numbers(batch.column(3), batch.column(7))
        for shard, doc_id, size, row, terms in zip(shards, numbers, sizes, rows, _terms(*batch.columns[4:8])):
            if ids and (shard != last or held + size > most):
                yield last, doc_ids, ids, found
                held, doc_ids, ids, found = 0, [], [], []
            last, held = shard, held + size
            doc_ids.append(doc_id)
            ids.append(row)
            found.append(terms)
    if ids:
        yield last, doc_ids, ids, found


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
