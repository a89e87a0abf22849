"""Best-fit-decreasing packing of token sequences, with a segment tree over remaining capacities.

Documents are packed where they are read: a task cuts its rows into batches of bounded size, encodes them, cuts
overlong documents into full windows without losing an id, packs the remainders and emits finished sequences. Nothing
is shuffled, so no key can be hot and a lost executor only repeats its own splits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from clipmetrics.llm import tokens
from clipmetrics.llm.words import slices

SCHEMA = (
    "sequence_id long, n_tokens int, n_segments int, doc_ids array<long>, starts array<long>, cu_lengths array<int>, "
    "ids binary, position_ids binary"
)


class Capacities:
    """Open bins by remaining capacity. A tree node holds whether any bin below it is open."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def _count(self, capacity: int, change: int) -> None:
        node = capacity + self.size
        while node:
            self.tree[node] += change
            node >>= 1

    def add(self, capacity: int, bin_id: int) -> None:
        heapq.heappush(self.bins[capacity], bin_id)
        self._count(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The bin with the smallest capacity that holds length, and that capacity; of equal ones the oldest."""
        node = length + self.size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):  # up, until a sibling to the right is open
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._count(capacity, -1)
        return heapq.heappop(self.bins[capacity]), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Item numbers of every bin. Items go from long to short, equal ones in input order, each to the tightest bin."""
    bins: list[list[int]] = []
    room = Capacities(window)
    for item in np.argsort(-lengths.astype(np.int64), kind="stable").tolist():
        length = int(lengths[item])
        found = room.take(length)
        if found is None:
            bins.append([])
            found = len(bins) - 1, window
        number, capacity = found
        bins[number].append(item)
        if capacity > length:
            room.add(capacity - length, number)
    return bins


def pack(doc_ids: list[int | None], ids: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document number, start, length); full windows of long documents come first."""
    sequences: list[list[tuple[int, int, int]]] = []
    rest = []
    for number, row in enumerate(ids):
        full = len(row) // window
        sequences += [[(number, k * window, window)] for k in range(full)]
        if len(row) % window:
            rest.append((number, full * window, len(row) % window))
    for items in best_fit_decreasing(np.array([r[2] for r in rest], dtype=np.int64), window):
        sequences.append([rest[i] for i in items])
    return sequences


def pack_binary(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, path: str | None = None,
    batch_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per packed sequence of at most `window` ids.

    ids holds little-endian ids (uint16 up to 65,536 ids, else uint32) padded with the closing id 0 to `window`,
    position_ids the positions within each segment (uint16, 0 in the padding), cu_lengths the running segment ends from 0 on; doc_ids and starts name
    the document of each segment and where in it the segment begins. Every id of every document, with its closing id,
    lies in exactly one segment. Null and empty texts are one closing id; null doc_ids stay null; repeated rows are
    packed each; an empty table gives no rows; other columns are ignored. A text beyond batch_bytes forms a batch of
    its own. sequence_id counts within the read partition, in its upper bits.
    """
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, places = tokens.width(path), "<u2" if window <= 1 << 16 else "<u4"
        next_id = TaskContext.get().partitionId() << 40
        for batch in gathered(batches, batch_bytes):
            doc_ids = batch.column(0).to_pylist()
            ids = [tokens.token_ids(t, path).astype(kind) for t in batch.column(1).to_pylist()]
            out = pack(doc_ids, ids, window)
            for at in range(0, len(out), 1024):
                part = out[at:at + 1024]
                yield _rows(part, doc_ids, ids, window, next_id, kind, places)
                next_id += len(part)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def gathered(batches: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches of about batch_bytes of text, whatever the size of the batches that come in."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, "text", batch_bytes):
            if held and size + part.nbytes > batch_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _rows(sequences: list, doc_ids: list, ids: list[np.ndarray], window: int, first_id: int, kind: str, places: str) -> pa.RecordBatch:
    columns: dict[str, list] = {name: [] for name in ("doc_ids", "starts", "cu", "ids", "positions", "n")}
    for segments in sequences:
        row, positions, ends = np.zeros(window, dtype=kind), np.zeros(window, dtype=places), [0]
        for number, start, length in segments:
            at = ends[-1]
            row[at:at + length] = ids[number][start:start + length]
            positions[at:at + length] = np.arange(length)
            ends.append(at + length)
        columns["doc_ids"].append([doc_ids[s[0]] for s in segments])
        columns["starts"].append([s[1] for s in segments])
        columns["cu"].append(ends)
        columns["ids"].append(row.tobytes())
        columns["positions"].append(positions.tobytes())
        columns["n"].append(ends[-1])
    return pa.RecordBatch.from_arrays([
        pa.array(range(first_id, first_id + len(sequences)), pa.int64()), pa.array(columns["n"], pa.int32()),
        pa.array([len(s) for s in sequences], pa.int32()), pa.array(columns["doc_ids"], pa.list_(pa.int64())),
        pa.array(columns["starts"], pa.list_(pa.int64())), pa.array(columns["cu"], pa.list_(pa.int32())),
        pa.array(columns["ids"], pa.binary()), pa.array(columns["positions"], pa.binary()),
    ], names=["sequence_id", "n_tokens", "n_segments", "doc_ids", "starts", "cu_lengths", "ids", "position_ids"])
