"""A bidirectional gated recurrent network with attention pooling, in numpy, over word and character inputs.

A word enters as the sum of the vectors of its own hash and of its character 3- and 5-grams, all from one table, so
inflected and unseen words share what their characters have learned.
"""

from __future__ import annotations

import numpy as np

from clipmetrics.llm.superkmers import mixed, word_hashes
from clipmetrics.llm.words import joined, word_bounds

Weights = dict[str, np.ndarray]


class Words:
    """The words of a batch of texts: for each text its words as numbers of distinct words, and the inputs of those."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: int, grams: tuple[int, ...] = (3, 5)) -> None:
        capital = (data >= 65) & (data <= 90)
        starts, ends, first = word_bounds(data, offsets)
        buffer, starts, ends = joined(data + 32 * capital.astype(np.uint8), starts, ends)
        self.counts = np.diff(first)
        hashes = word_hashes(buffer, starts, ends)
        distinct, where, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        starts, ends = starts[where], ends[where]
        padded = np.concatenate([[np.uint8(32)], buffer, np.full(max(grams), 32, np.uint8)]).astype(np.uint64)
        ids, owners = [(distinct % np.uint64(rows)).astype(np.int64)], [np.arange(len(distinct))]
        for n in grams:
            rolled = np.full(len(buffer) + 1, n, dtype=np.uint64)
            for k in range(n):
                rolled = rolled * np.uint64(0x100000001B3) + padded[k:k + len(rolled)]
            counts = np.maximum(ends - starts + 2 - n + 1, 0)  # with the spaces on either side
            at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            ids.append((mixed(rolled[at]) % np.uint64(rows)).astype(np.int64))
            owners.append(np.repeat(np.arange(len(distinct)), counts))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.inputs = np.concatenate(ids)[order].astype(np.int32)
        self.begins = np.searchsorted(owner[order], np.arange(len(distinct)))

    @classmethod
    def together(cls, parts: list[Words]) -> Words:
        """The texts of all parts; a word of two parts stays two distinct words with the same inputs."""
        out = cls.__new__(cls)
        words = np.cumsum([0, *(len(p.begins) for p in parts)])
        inputs = np.cumsum([0, *(len(p.inputs) for p in parts)])
        out.counts = np.concatenate([p.counts for p in parts])
        out.number = np.concatenate([p.number + n for p, n in zip(parts, words)])
        out.inputs = np.concatenate([p.inputs for p in parts])
        out.begins = np.concatenate([p.begins + n for p, n in zip(parts, inputs)])
        return out

    def vectors(self, table: np.ndarray) -> np.ndarray:
        """Input vector of every distinct word, and a zero vector behind them for places without a word."""
        out = np.zeros((len(self.begins) + 1, table.shape[1]), table.dtype)
        for at in range(0, len(self.begins), 1 << 14):
            begins = self.begins[at:at + (1 << 14)]
            end = self.begins[at + len(begins)] if at + len(begins) < len(self.begins) else len(self.inputs)
            out[at:at + len(begins)] = np.add.reduceat(table[self.inputs[begins[0]:end]], begins - begins[0], axis=0)
        return out


def windows(counts: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of all overlapping windows that cover every text; a text without words has an empty one."""
    each = np.maximum(-(-(counts - length) // stride), 0) + 1
    text = np.repeat(np.arange(len(counts)), each)
    nth = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    base = np.repeat(np.cumsum(counts) - counts, each)
    first = base + nth * stride
    return text, first, np.minimum(first + length, base + counts[text])


def places(first: np.ndarray, end: np.ndarray, length: int, number: np.ndarray, blank: int) -> np.ndarray:
    """(window, place): distinct-word numbers, blank beyond the end."""
    out = np.full((len(first), length), blank, dtype=np.int32)
    for t in range(length):
        inside = first + t < end
        out[inside, t] = number[first[inside] + t]
    return out


def initial(rows: int, width: int, hidden: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    weights = {"table": normal(rows, width, scale=0.01), "score": normal(2 * hidden, scale=0.3), "bias": np.zeros(1, np.float32),
               "attend": normal(2 * hidden, 2 * hidden, scale=0.3), "focus": normal(2 * hidden, scale=0.3)}
    for side in ("ahead", "back"):
        weights[f"{side}_in"] = normal(width, 3 * hidden, scale=0.4)
        weights[f"{side}_own"] = normal(hidden, 3 * hidden, scale=0.3)
        weights[f"{side}_bias"] = np.zeros(3 * hidden, np.float32)
    return weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _steps(given: np.ndarray, own: np.ndarray, words: np.ndarray, blank: int, order: range, keep: list | None) -> np.ndarray:
    """States after every place, in place order. given: gate inputs by distinct word."""
    hidden = own.shape[0]
    state = np.zeros((len(words), hidden), np.float32)
    states = np.zeros((len(words), words.shape[1], hidden), np.float32)
    for t in order:
        x = given[words[:, t]]
        gates = _sigmoid(x[:, :2 * hidden] + state @ own[:, :2 * hidden])
        update, reset = gates[:, :hidden] * (words[:, t] != blank)[:, None], gates[:, hidden:]
        fresh = np.tanh(x[:, 2 * hidden:] + (reset * state) @ own[:, 2 * hidden:])
        if keep is not None:
            keep.append((t, state, update, reset, fresh))
        state = state + update * (fresh - state)
        states[:, t] = state
    return states


def logits(weights: Weights, vectors: np.ndarray, words: np.ndarray, trace: dict | None = None) -> np.ndarray:
    """One value for each window. vectors: inputs of the distinct words; words: their numbers at each place."""
    blank, length = len(vectors) - 1, words.shape[1]
    states = []
    for side, order in (("ahead", range(length)), ("back", range(length - 1, -1, -1))):
        given = vectors @ weights[f"{side}_in"] + weights[f"{side}_bias"]
        keep = None if trace is None else trace.setdefault(side, [])
        states.append(_steps(given, weights[f"{side}_own"], words, blank, order, keep))
    both = np.concatenate(states, axis=2)
    heard = np.tanh(both @ weights["attend"])
    rank = np.where(words == blank, -1e9, heard @ weights["focus"])
    share = np.exp(rank - rank.max(axis=1, keepdims=True)) * (words != blank)
    share = (share / np.maximum(share.sum(axis=1, keepdims=True), 1e-9)).astype(np.float32)
    pooled = np.einsum("bt,bth->bh", share, both)
    if trace is not None:
        trace |= {"both": both, "heard": heard, "share": share, "pooled": pooled}
    return pooled @ weights["score"] + weights["bias"]


def gradients(weights: Weights, vectors: np.ndarray, words: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, Weights, np.ndarray]:
    """Loss, gradients of the dense weights and of the input vectors."""
    trace: dict = {}
    z = logits(weights, vectors, words, trace)
    p = _sigmoid(z)
    loss = float((weight * (np.logaddexp(0, z) - labels * z)).mean())
    dz = (weight * (p - labels) / len(z)).astype(np.float32)
    both, heard, share = trace["both"], trace["heard"], trace["share"]
    out: Weights = {"score": trace["pooled"].T @ dz, "bias": dz.sum(keepdims=True)}
    dpooled = dz[:, None] * weights["score"]
    dboth = share[:, :, None] * dpooled[:, None, :]
    dshare = np.einsum("bth,bh->bt", both, dpooled)
    drank = share * (dshare - (share * dshare).sum(axis=1, keepdims=True))
    out["focus"] = np.einsum("bth,bt->h", heard, drank)
    dheard = drank[:, :, None] * weights["focus"] * (1 - heard**2)
    out["attend"] = np.einsum("bti,btj->ij", both, dheard)
    dboth = dboth + dheard @ weights["attend"].T
    hidden = weights["ahead_own"].shape[0]
    dvectors = np.zeros_like(vectors)
    for side, part in (("ahead", slice(0, hidden)), ("back", slice(hidden, 2 * hidden))):
        own = weights[f"{side}_own"]
        dgiven, down = np.zeros((len(vectors), 3 * hidden), np.float32), np.zeros_like(own)
        dplaces = np.zeros((words.shape[1], len(words), 3 * hidden), np.float32)
        dstate = np.zeros((len(words), hidden), np.float32)
        for t, state, update, reset, fresh in reversed(trace[side]):
            dstate = dstate + dboth[:, t, part]
            dfresh = dstate * update * (1 - fresh**2)
            dmixed = dfresh @ own[:, 2 * hidden:].T
            live = words[:, t] != len(vectors) - 1
            dupdate = dstate * (fresh - state) * update * (1 - update) * live[:, None]
            dreset = dmixed * state * reset * (1 - reset)
            gate = np.concatenate([dupdate, dreset], axis=1)
            down[:, :2 * hidden] += state.T @ gate
            down[:, 2 * hidden:] += (reset * state).T @ dfresh
            dstate = dstate * (1 - update) + dmixed * reset + gate @ own[:, :2 * hidden].T
            dplaces[t] = np.concatenate([gate, dfresh], axis=1)
        np.add.at(dgiven, words.T, dplaces)
        out[f"{side}_own"], out[f"{side}_bias"] = down, dgiven.sum(axis=0)
        out[f"{side}_in"] = vectors.T @ dgiven
        dvectors += dgiven @ weights[f"{side}_in"].T
    return loss, out, dvectors


class Adam:
    """Adam for the dense weights, and for the rows of the table that a step touched."""

    def __init__(self, weights: Weights, rate: float) -> None:
        self.weights, self.rate, self.steps = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: Weights, rows: np.ndarray, row_grads: np.ndarray) -> None:
        self.steps += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for key, g, at in [(k, g, slice(None)) for k, g in grads.items()] + [("table", row_grads, rows)]:
            mean, square = self.mean[key], self.square[key]
            mean[at] = 0.9 * mean[at] + 0.1 * g
            square[at] = 0.999 * square[at] + 0.001 * g * g
            self.weights[key][at] -= (scale * mean[at] / (np.sqrt(square[at]) + 1e-7)).astype(np.float32)
