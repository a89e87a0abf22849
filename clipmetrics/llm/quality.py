"""Quality of whole texts: random-indexing vectors pooled per document, then a two-layer network in numpy.

The word vectors take in every document; the network is trained on a bounded sample of labelled ones, and one
temperature, chosen on a part of the sample that training does not see, calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from clipmetrics.llm.labels import picked_labels, with_labels
from clipmetrics.llm.randomindex import contexts, pooled
from clipmetrics.llm.words import slices


@dataclass
class Network:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        first, shift, second, bias = self.weights
        return np.tanh((features - self.mean) / self.scale @ first + shift) @ second + bias

    def scores(self, column: pa.Array) -> np.ndarray:
        z = self.logits(pooled(column, self.vectors)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _loss(z: np.ndarray, labels: np.ndarray) -> float:
    return float((np.logaddexp(0, z) - labels * z).mean())


def train(
    vectors: np.ndarray, features: np.ndarray, labels: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 64,
    rate: float = 0.004, decay: float = 1e-3, seed: int = 3,
) -> Network:
    """A calibrated network. Without rows of both labels its score is the one label there is, or 0.5 without rows."""
    rng = np.random.default_rng(seed)
    width = features.shape[1]
    network = Network(vectors, np.zeros(width, np.float32), np.ones(width, np.float32), [
        (rng.standard_normal((width, hidden)) / np.sqrt(width)).astype(np.float32), np.zeros(hidden, np.float32),
        (rng.standard_normal(hidden) / np.sqrt(hidden)).astype(np.float32), np.zeros(1, np.float32)])
    if len(set(labels.tolist())) < 2:
        network.weights[2][:] = 0
        network.weights[3][:] = 0 if not len(labels) else 10 if labels[0] else -10
        return network
    network.mean, network.scale = features.mean(axis=0), features.std(axis=0) + 1e-4
    order = rng.permutation(len(labels))
    held, own = order[:len(order) // 5], order[len(order) // 5:]
    mean, square = [np.zeros_like(w) for w in network.weights], [np.zeros_like(w) for w in network.weights]
    step = 0
    for _ in range(max(epochs, -(-2000 * batch // max(len(own), 1)))):
        shuffled = rng.permutation(own)
        for at in range(0, len(shuffled), batch):
            pick, step = shuffled[at:at + batch], step + 1
            x = (features[pick] - network.mean) / network.scale
            inner = np.tanh(x @ network.weights[0] + network.weights[1])
            z = inner @ network.weights[2] + network.weights[3]
            dz = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[pick]) / len(pick)).astype(np.float32)
            dinner = dz[:, None] * network.weights[2] * (1 - inner**2)
            grads = [x.T @ dinner + decay * network.weights[0], dinner.sum(axis=0), inner.T @ dz + decay * network.weights[2], dz.sum(keepdims=True)]
            scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, g, m, s in zip(network.weights, grads, mean, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= (scale * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    if len(held) and len(set(labels[held].tolist())) == 2:
        z = network.logits(features[held])
        choices = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
        network.temperature = float(min(choices, key=lambda t: _loss(z / t, labels[held])))
    return network


def fit(
    docs: DataFrame, labels: DataFrame, allowed: Column, low_rows: int = 3000, high_rows: int = 6000,
    text_col: str = "text", **parameters,
) -> Network:
    """Word vectors from all docs, then a network from a sample bounded by low_rows and high_rows."""
    vectors = contexts(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = pooled(part.column(1), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(list(found), pa.list_(pa.float32()))], names=["id", "label", "features"])

    sample = with_labels(docs, picked_labels(labels, "quality", allowed, {0: low_rows, 1: high_rows}), text_col=text_col)
    rows = sorted(sample.mapInArrow(run, "id long, label int, features array<float>").collect())
    features = np.array([r[2] for r in rows], dtype=np.float32).reshape(len(rows), -1)
    return train(vectors, features, np.array([r[1] for r in rows], dtype=np.float32), **parameters)


def with_score(df: DataFrame, network: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with the score of every whole text in a new last column.

    Null and empty texts have no tokens and are scored as the zero vector. Repeated rows are scored each; an empty
    table gives no rows; other columns are kept as they are, and one called score_col is an error.
    """
    if score_col in df.columns:
        raise ValueError(f"df already has a column {score_col!r}")
    shared = df.sparkSession.sparkContext.broadcast(network)  # of fixed size: weights only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                found = pa.array(shared.value.scores(part.column(part.schema.get_field_index(text_col))))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, score_col])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(score_col, DoubleType())]))
