"""Super-k-mers of whole texts: runs of word windows that share a minimiser, cut out as one string each."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from clipmetrics.llm.words import blocks, joined, word_bounds

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        row = np.full(n, base, dtype=np.uint64)
        row[:1] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the values of x over all 64 bits, one to one."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from running sums over the bytes of a block; the place of a word does not matter."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for low, high in blocks(ends):
        begin, end = int(starts[low]), int(ends[high - 1])
        up, down = _powers(1 << max(end - begin + 1, 1 << 20).bit_length())
        sums = np.zeros(end - begin + 1, dtype=np.uint64)
        np.cumsum((buffer[begin:end].astype(np.uint64) + np.uint64(1)) * up[:end - begin], out=sums[1:])
        first = starts[low:high] - begin
        out[low:high] = mixed((sums[ends[low:high] - begin] - sums[first]) * down[first])
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n consecutive words; one value for each place they can begin."""
    size = max(len(words) - n + 1, 0)
    total = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k:k + size]
    return mixed(total)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours, by doubling."""
    reach, low = 1, x
    while 2 * reach <= n:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = n - reach
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


class Runs:
    """Runs of windows of one batch of texts: document, first word there, number of windows, minimiser, byte range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int, m: int, longest: int = 256) -> None:
        starts, ends, first = word_bounds(data, offsets)
        self.words = np.diff(first)
        self.buffer, starts, ends = joined(data, starts, ends)
        hashes = word_hashes(self.buffer, starts, ends)
        owner = np.repeat(np.arange(len(self.words)), self.words)
        places = max(len(hashes) - k + 1, 0)
        keys = sliding_min(gram_hashes(hashes, m), k - m + 1) if places else np.zeros(0, np.uint64)
        whole = owner[:places] == owner[k - 1:k - 1 + places]
        begins = whole.copy()
        begins[1:] &= ~(whole[:-1] & (keys[1:] == keys[:-1]) & (owner[1:places] == owner[:places - 1]))
        at = np.flatnonzero(begins)
        sizes = np.diff(np.append(np.flatnonzero(whole).searchsorted(at), int(whole.sum())))
        if len(sizes) and sizes.max() > longest:  # one word repeated: cut, which changes no window
            parts = -(-sizes // longest)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at, sizes = np.repeat(at, parts) + nth * longest, np.minimum(longest, np.repeat(sizes, parts) - nth * longest)
        self.keys, self.windows, self.doc = keys[at].view(np.int64), sizes, owner[at] if len(at) else at
        self.start = at - first[self.doc]
        self.low, self.high = starts[at], ends[at + sizes + k - 2] if len(at) else at

    def strings(self) -> list[bytes]:
        raw = self.buffer.tobytes()
        return [raw[a:b] for a, b in zip(self.low.tolist(), self.high.tolist())]

    def select(self, kept: np.ndarray) -> Runs:
        """Drop all other runs."""
        for name in ("keys", "windows", "doc", "start", "low", "high"):
            setattr(self, name, getattr(self, name)[kept])
        return self
