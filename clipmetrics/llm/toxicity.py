"""Toxicity of whole texts: the largest score of all overlapping word windows under a recurrent network.

The network (gru.py) is trained here in numpy on a bounded sample of labelled documents. A label speaks of a document,
not of a place in it, so training picks the place: first the windows of toxic documents with the character grams and
words most over-represented in them, then those the network itself scores highest; of clean documents all windows are
candidates and the highest ones are learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from clipmetrics.llm import gru
from clipmetrics.llm.labels import training_rows
from clipmetrics.llm.words import slices, text_buffer


@dataclass
class Scorer:
    """Trained weights and the line that turns the largest logit of a text into a probability."""

    weights: gru.Weights
    slope: float
    shift: float
    length: int = 32
    stride: int = 24

    def text_logits(self, column: pa.Array) -> np.ndarray:
        words = gru.Words(*text_buffer(column), len(self.weights["table"]))
        vectors = words.vectors(self.weights["table"])
        text, first, end = gru.windows(words.counts, self.length, self.stride)
        best = np.full(len(words.counts), -np.inf, dtype=np.float32)
        for at in range(0, len(text), 4096):
            part = slice(at, at + 4096)
            placed = gru.places(first[part], end[part], self.length, words.number, len(vectors) - 1)
            np.maximum.at(best, text[part], gru.logits(self.weights, vectors, placed))
        return best.astype(np.float64)

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.text_logits(column) + self.shift, -50, 50)))


def _held(words: gru.Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """text and input of every input that a text has, once each."""
    pairs = np.unique(np.repeat(np.arange(len(words.counts)), words.counts) * max(len(words.begins), 1) + words.number)
    text, word = np.divmod(pairs, max(len(words.begins), 1))
    counts = (np.append(words.begins[1:], len(words.inputs)) - words.begins)[word]
    at = np.repeat(words.begins[word] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return np.divmod(np.unique(np.repeat(text, counts) * rows + words.inputs[at]), rows)


def _log_odds(parts: list[gru.Words], labels: np.ndarray, rows: int) -> np.ndarray:
    """For every input the log odds to occur in a toxic rather than a clean text; 0 for those of fewer than two toxic texts."""
    held, first = np.zeros((2, rows)), 0
    for words in parts:
        text, inputs = _held(words, rows)
        for label in (0, 1):
            held[label] += np.bincount(inputs[labels[first + text] == label], minlength=rows)
        first += len(words.counts)
    odds = np.log((held[1] + 0.1) / (labels.sum() + 1)) - np.log((held[0] + 0.1) / ((1 - labels).sum() + 1))
    return np.where(held[1] < 2, 0, odds).astype(np.float32)


def _inputs(words: gru.Words, placed: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For some windows the vectors of their own distinct words, their words numbered among those, and what was added up."""
    blank = len(words.begins)
    used = np.unique(placed[placed < blank])
    local = np.full(placed.shape, len(used))
    local[placed < blank] = np.searchsorted(used, placed[placed < blank])
    counts = np.append(words.begins[1:], len(words.inputs))[used] - words.begins[used]
    owner = np.repeat(np.arange(len(used)), counts)
    inputs = words.inputs[np.repeat(words.begins[used] - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))]
    vectors = np.zeros((len(used) + 1, table.shape[1]), table.dtype)
    np.add.at(vectors, owner, table[inputs])
    return vectors, local, inputs, owner


def train(
    rows: list[tuple[str, int]], table_rows: int = 1 << 16, width: int = 12, hidden: int = 8, rounds: int = 5, steps: int = 260,
    batch: int = 128, rate: float = 0.01, seed: int = 5,
) -> Scorer:
    """A scorer from (text, label) pairs. Without both labels the score is the share of toxic labels everywhere."""
    labels = np.array([label for _, label in rows], dtype=np.float32)
    scorer = Scorer(gru.initial(table_rows, width, hidden, seed), 0.0, 0.0)
    if len(set(labels.tolist())) < 2:
        scorer.shift = 50.0 if len(labels) and labels[0] == 1 else -50.0
        return scorer
    rows = [*rows, *[("", 0)] * (len(rows) // 100 + 1)]  # a text without words is clean
    labels = np.array([label for _, label in rows], dtype=np.float32)
    texts = pa.RecordBatch.from_arrays([pa.array([text for text, _ in rows], pa.large_string())], names=["text"])
    parts = [gru.Words(*text_buffer(part.column(0)), table_rows) for part in slices(texts, "text", 1 << 19)]
    odds = _log_odds(parts, labels, table_rows)
    words = gru.Words.together(parts)
    del texts, parts
    text, first, end = gru.windows(words.counts, scorer.length, scorer.stride)
    placed = gru.places(first, end, scorer.length, words.number, len(words.begins))
    rank = np.append(np.maximum.reduceat(odds[words.inputs], words.begins), np.float32(0))[placed].max(axis=1)
    rng = np.random.default_rng(seed)
    optimizer = gru.Adam(scorer.weights, rate)
    for _ in range(rounds):
        order = np.lexsort((rng.random(len(text)), -rank, text))
        place = np.arange(len(text)) - np.searchsorted(text[order], text[order])
        toxic = labels[text[order]] == 1
        chosen = order[np.where(toxic, place == 0, place < 3)]
        others = order[~toxic & (place >= 3)]
        chosen = np.concatenate([chosen, rng.choice(others, min(len(others), len(chosen)), replace=False)])
        target = labels[text[chosen]]
        balance = np.where(target == 1, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6)).astype(np.float32)
        shuffled = np.concatenate([rng.permutation(len(chosen)) for _ in range(-(-steps * batch // len(chosen)))])
        for at in range(0, steps * batch, batch):
            pick = shuffled[at:at + batch]
            vectors, local, inputs, owner = _inputs(words, placed[chosen[pick]], scorer.weights["table"])
            _, grads, dvectors = gru.gradients(scorer.weights, vectors, local, target[pick], balance[pick])
            touched, where = np.unique(inputs, return_inverse=True)
            row_grads = np.zeros((len(touched), width), np.float32)
            np.add.at(row_grads, where, dvectors[owner])
            optimizer.step(grads, touched, row_grads)
        rank = np.concatenate([
            gru.logits(scorer.weights, *_inputs(words, placed[at:at + 1024], scorer.weights["table"])[:2]) for at in range(0, len(placed), 1024)])
    best = np.full(len(labels), -np.inf)
    np.maximum.at(best, text, rank)
    scorer.slope, scorer.shift = _line(best, labels)
    return scorer


def _line(values: np.ndarray, labels: np.ndarray, steps: int = 300, hold: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of a logistic regression on one value, by Newton steps with a small penalty."""
    x = np.stack([values, np.ones_like(values)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (p - labels) / len(labels) + hold * (w - [1.0, 0.0])
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(labels) + hold * np.eye(2)
        step = np.linalg.solve(curve, grad)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(
    docs: DataFrame, labels: DataFrame, allowed: Column, toxic_rows: int = 1300, clean_rows: int = 2600, **parameters,
) -> Scorer:
    """Train on a sample bounded by toxic_rows and clean_rows."""
    return train(training_rows(docs, labels, "toxic", allowed, {1: toxic_rows, 0: clean_rows}), **parameters)


def with_score(df: DataFrame, scorer: Scorer, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with the score of every whole text in a new last column.

    Null and empty texts are one empty window. Repeated rows are scored each; an empty table gives no rows; other
    columns are kept as they are, and one called score_col is an error.
    """
    if score_col in df.columns:
        raise ValueError(f"df already has a column {score_col!r}")
    shared = df.sparkSession.sparkContext.broadcast(scorer)  # of fixed size: weights only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                found = pa.array(shared.value.scores(part.column(part.schema.get_field_index(text_col))))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, score_col])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(score_col, DoubleType())]))
