"""The vote of many distinct texts of one segment, without comparing all of them with each other.

Two bounds on the matching-blocks ratio 2M/S of two texts (M matched characters, S both lengths) do the work:

* Of the M - 1 neighbours among the matched characters at most S - 2M are torn apart by unmatched ones, so the texts share at
  least 3M - 1 - S pairs of adjacent characters. With M >= t S / 2 that is (1.5 t - 1) S - 1 pairs, and M characters anyway.
* M is at most the number of characters the texts have in common. Summed over all others this needs only the votes per
  character and length, not the pairs.

Repeated characters and pairs count as often as they occur in both: the second "a" of a text is a mark of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np

Close = Callable[[str, str, float], float]
Mark = tuple[str, int]
#: So many candidates are compared as they are; more are first held against the characters they have in common.
FEW = 16
#: Up to so many texts the bounds cost more than the comparisons they spare.
SMALL = 12


def marks(value: str, width: int) -> list[Mark]:
    """The pieces of this width, each numbered by how often it occurred before."""
    seen: dict[str, int] = defaultdict(int)
    out = []
    for at in range(len(value) - width + 1):
        piece = value[at:at + width]
        out.append((piece, seen[piece]))
        seen[piece] += 1
    return out


class _Postings:
    """Which texts have a mark, in arrays that grow by doubling."""

    def __init__(self) -> None:
        self.of: dict[Mark, np.ndarray] = {}
        self.used: dict[Mark, int] = {}

    def add(self, mark: Mark, text: int) -> None:
        used, held = self.used.get(mark, 0), self.of.get(mark)
        if held is None:
            held = self.of[mark] = np.empty(4, np.int32)
        elif used == len(held):
            held = self.of[mark] = np.concatenate([held, np.empty(used, np.int32)])
        held[used] = text
        self.used[mark] = used + 1

    def counts(self, wanted: Iterable[Mark], texts: int) -> np.ndarray:
        """For each text so far, how many of the wanted marks it has."""
        total = np.zeros(texts, np.int32)
        for mark in wanted:
            if mark in self.of:
                total[self.of[mark][:self.used[mark]]] += 1  # a text has a mark once
        return total


class Links:
    """Earlier texts that may reach the threshold with a new one; none that does is left out."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.lengths = np.empty(16, np.int32)
        self.n = 0
        self.pairs, self.characters = _Postings(), _Postings()

    def candidates(self, value: str) -> tuple[np.ndarray, np.ndarray]:
        """Their numbers, and what their ratios cannot exceed."""
        size, t = len(value), self.threshold
        lengths = self.lengths[:self.n].astype(np.int64)
        both = lengths + size
        slack = 1e-9 * both
        possible = 2.0 * np.minimum(lengths, size) >= t * both - slack
        needed = (1.5 * t - 1.0) * both - 1.0 - slack
        matched = np.minimum(lengths, size)
        if self.n and (needed[possible] > 0).any():
            shared = self.pairs.counts(marks(value, 2), self.n)
            possible &= shared >= needed
            matched = np.minimum(matched, (shared + 1 + both) // 3)
        if np.count_nonzero(possible) > FEW:
            common = self.characters.counts(marks(value, 1), self.n)
            possible &= 2.0 * common >= t * both - slack
            matched = np.minimum(matched, common)
        found = np.flatnonzero(possible)
        return found, 2.0 * matched[found] / np.maximum(both[found], 1)

    def add(self, value: str) -> None:
        if self.n == len(self.lengths):
            self.lengths = np.concatenate([self.lengths, np.empty(self.n, np.int32)])
        self.lengths[self.n] = len(value)
        for width, held in ((2, self.pairs), (1, self.characters)):
            for mark in marks(value, width):
                held.add(mark, self.n)
        self.n += 1


def _from_the_highest(found: np.ndarray, bounds: np.ndarray, where: list[int], score: Callable[[], float]) -> Iterator[int]:
    """Candidates in the order of their bounds, the highest first, as long as one can reach the score found so far."""
    if not len(found):
        return
    first = int(bounds.argmax())
    yield where[found[first]]
    rest = np.flatnonzero(bounds >= score())
    for at in rest[np.argsort(-bounds[rest], kind="stable")].tolist():
        if bounds[at] < score():
            return
        if at != first:
            yield where[found[at]]


def clusters(texts: list[str], threshold: float, close: Close, bounded: bool) -> list[list[int]]:
    """Each text joins the cluster that holds the earlier text closest to it, from the threshold on; else it opens one.

    Of equally close clusters the first one takes it. An empty text is alone. bounded tells that close is the
    matching-blocks ratio, for which the bounds above hold; any other is asked for all earlier texts.
    """
    groups: list[list[int]] = []
    owner: list[int] = []
    filled = bounded and threshold > 0 and len(texts) > SMALL
    links, where = Links(threshold), []
    for i, value in enumerate(texts):
        best, score = -1, 0.0
        if value:
            for j in _from_the_highest(*links.candidates(value), where, lambda: score) if filled else range(i):
                found = close(value, texts[j], threshold)
                if found >= threshold and (best < 0 or found > score or (found == score and owner[j] < best)):
                    best, score = owner[j], found
            if filled:
                links.add(value)
                where.append(i)
        elif groups and threshold <= 0:
            best = 0
        if best < 0:
            best = len(groups)
            groups.append([])
        groups[best].append(i)
        owner.append(best)
    return groups


def peer_bounds(texts: list[str], votes: list[int]) -> list[float]:
    """For each text, at least the sum of its ratios with all texts times their votes, its own included once per vote."""
    per_length: dict[int, dict[Mark, int]] = defaultdict(lambda: defaultdict(int))
    own = [marks(value, 1) for value in texts]
    for value, held, weight in zip(texts, own, votes):
        table = per_length[len(value)]
        for mark in held:
            table[mark] += weight
    out = []
    for value, held in zip(texts, own):
        out.append(sum(2.0 / (len(value) + length) * sum(table.get(m, 0) for m in held) for length, table in per_length.items() if value))
    return out


def spokesman(texts: list[str], votes: list[int], standing: Callable[[int, float], tuple], peers_of: Callable[[int], float], bounded: bool) -> int:
    """The text of a cluster with the largest standing(i, peers), which must not fall when peers grow.

    Texts are asked for their true peers in the order of their bounds, until no bound reaches the best one found.
    """
    if len(texts) == 1:
        return 0
    if not bounded or len(texts) <= SMALL:
        return max(range(len(texts)), key=lambda i: standing(i, peers_of(i)))
    slack = 1e-9 * (1 + sum(votes))
    hopes = [standing(i, peers + slack) for i, peers in enumerate(peer_bounds(texts, votes))]
    best, found = -1, None
    for i in sorted(range(len(texts)), key=hopes.__getitem__, reverse=True):
        if found is not None and hopes[i] < found:
            break
        own = standing(i, peers_of(i))
        # Equal standings cannot occur twice: the last part is the number of the text's own observation.
        if found is None or own > found:
            best, found = i, own
    return best
