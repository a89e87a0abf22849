"""Exact, near and substring deduplication against plain versions."""

from __future__ import annotations

import hashlib
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from cases import SCHEMA, documents, frame, words  # noqa: E402

from clipmetrics.llm import components, exact, simhash, substrings, superkmers  # noqa: E402
from clipmetrics.llm.words import text_buffer, word_bounds  # noqa: E402


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.pmod(F.length(c), F.lit(3)).cast("string")])
def test_exact_classes(spark, digest):
    """Also with a digest that almost all texts share: contents decide."""
    rows = documents()
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    got = exact.exact_classes(frame(spark, rows), digest=digest).collect()
    want = Counter()
    for r in rows:
        ids = groups[lower(r[1])]
        keep = max((i for i in ids if i is not None), default=None)
        want[(r[0], keep, len(ids), r[0] == keep)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want


def test_keep_exact_leaves_one_row_of_each_class(spark):
    rows = documents()
    kept = exact.keep_exact(frame(spark, rows)).collect()
    assert kept[0].__fields__ == [c.split()[0] for c in SCHEMA.split(", ")]
    assert Counter(lower(r.text) for r in kept) == Counter({lower(r[1]): 1 for r in rows})
    assert exact.keep_exact(frame(spark, [])).count() == exact.exact_classes(frame(spark, [])).count() == 0


def fingerprint(text):
    ws = words(lower(text))
    shingles = [b" ".join(ws[i:i + 4]) for i in range(len(ws) - 3)] or ([b" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(values, near):
    """Number of the component of every value, by comparing all pairs."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if near(a, values[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_near_duplicates(spark):
    rows = documents()
    marks = [fingerprint(r[1]) for r in rows]
    comp = classes(marks, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {c: min((r[0] for r, d in zip(rows, comp) if d == c and r[0] is not None), default=None) for c in comp}
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == Counter((r[0], m, least[c]) for r, m, c in zip(rows, marks, comp))
    kept = simhash.keep_first(frame(spark, rows)).collect()
    assert len(kept) == len(set(comp)) and len(kept[0]) == len(SCHEMA.split(", "))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_links_of_hot_meetings_are_whole(spark):
    """Many fingerprints around one centre, cut into pieces far smaller than the meeting."""
    rng = random.Random(4)
    centre = 0x0123456789ABCDEF
    values = {centre}
    while len(values) < 300:
        x = rng.choice(sorted(values)[:40])
        for k in rng.sample(range(64), rng.choice((1, 3, 5))):
            x ^= 1 << k
        values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    marks = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.u: r.root for r in components.components(simhash.links(marks, meeting=16)).collect()}
    got = [roots.get(v, v) for v in signed]
    want = classes(values, lambda a, b: (a ^ b).bit_count() <= 4)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3)]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 150)}}


def without_repeats(rows, k=13):
    first = {}
    for i, text in rows:
        ws = words(text)
        for j in range(len(ws) - k + 1):
            if i is not None:
                key = tuple(ws[j:j + k])
                first[key] = min(first.get(key, i), i)
    for i, text in rows:
        ws = words(text)
        gone = [False] * len(ws)
        for j in range(len(ws) - k + 1):
            if i is not None and first[tuple(ws[j:j + k])] < i:
                gone[j:j + k] = [True] * k
        kept = b" ".join(w for w, g in zip(ws, gone) if not g)
        yield i, len(ws), sum(gone), kept.decode(), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("parameters", [{}, {"share": 1e-9, "least": 2}, {"rounds": 5, "m": 1}])
def test_remove_repeats(spark, parameters):
    """Also where almost every minimiser is frequent and split by window."""
    rows = documents()
    got = substrings.remove_repeats(frame(spark, rows), **parameters).collect()
    assert Counter(map(tuple, got)) == Counter(without_repeats([r[:2] for r in rows]))
    assert sum(r.n_removed for r in got) > 300
    assert substrings.remove_repeats(frame(spark, []), **parameters).count() == 0


def test_runs_hold_every_window_once():
    texts = [r[1] for r in documents()]
    runs = superkmers.Runs(*text_buffer(pa.array(texts)), 13, 3)
    seen = Counter()
    for doc, start, n, string in zip(runs.doc.tolist(), runs.start.tolist(), runs.windows.tolist(), runs.strings()):
        ws = string.split(b" ")
        assert len(ws) == n + 12
        for i in range(n):
            seen[(doc, start + i, tuple(ws[i:i + 13]))] += 1
    want = Counter((d, i, tuple(w[i:i + 13])) for d, w in enumerate(map(words, texts)) for i in range(len(w) - 12))
    assert seen == want


def test_words_are_runs_outside_six_spaces():
    texts = ["a\x0bb\x0cc\r\n d\x1ce\x85f g", None, "", "  ", "é é", "x"]
    data, offsets = text_buffer(pa.array(texts))
    starts, ends, first = word_bounds(data, offsets)
    raw = data.tobytes()
    got = [[raw[s:e] for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == [words(t) for t in texts]


def test_pivot_filter_loses_nothing():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64)) for _ in range(5)]]))
    u, v = simhash.forest(values, None, 4, simhash.pivots(8))
    assert (np.bitwise_count(u ^ v) <= 64).all() and len(u) == len(values) - len(set(classes(values.tolist(), lambda a, b: (a ^ b).bit_count() <= 4)))


def test_very_long_texts_are_hashed_block_by_block():
    """Words get the same hash wherever they lie, in a text of many blocks and with a word longer than a block."""
    text = "alpha beta gamma " * 200_000 + "x" * 1_500_000 + " beta"
    data, offsets = text_buffer(pa.array(["beta alpha gamma", text]))
    starts, ends, first = word_bounds(data, offsets)
    hashes = superkmers.word_hashes(data, starts, ends)
    beta, alpha, gamma = hashes[:3].tolist()
    assert (hashes[3:600_003].reshape(-1, 3) == np.array([alpha, beta, gamma], dtype=np.uint64)).all()
    assert hashes[-1] == beta and len(set(hashes.tolist())) == 4
    from clipmetrics.llm.words import joined

    out, to, until = joined(data, starts, ends)
    assert out.tobytes() == b"beta alpha gamma " + text.encode() + b" "
    assert (superkmers.word_hashes(out, to, until) == hashes).all()


def test_rows_of_one_id_lose_only_what_their_own_windows_cover(spark):
    """An id that repeats with another text, once more often than a hot window's bound."""
    passage = " ".join(f"p{i}" for i in range(13))
    rows = [(1, passage), (5, passage + " tail"), (5, " ".join(f"q{i}" for i in range(20))), (5, passage + " tail"), (7, None), (7, passage.upper())]
    rows += [(9 + i, passage) for i in range(40)] + [(9, passage)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(without_repeats(rows))
    assert Counter(map(tuple, substrings.remove_repeats(df).collect())) == want
    docs = substrings._documents(df, "doc_id", "text")
    spans = substrings._frequent_spans(docs, 13, 3, np.unique([k for _, _, r in substrings._batches(
        docs.toArrow().to_batches(), 13, 3) for k in r.keys.view(np.uint64)]), most=10, salts=4)
    assert spans.count() == sum(1 for i, t in rows if i > 1 and t and t.startswith(passage))
