"""Collocations, spelling variants and exact top-k search against plain versions."""

from __future__ import annotations

import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import SCHEMA, documents, frame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from clipmetrics.llm import collocations, plans, threshold, variants  # noqa: E402


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_collocations(rows, least, percent, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            ws = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(ws)
            for k in range(1, 6):
                counts[lang or "und"].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        rows = []
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in good.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside.get(p[i:j], 0), a)
        for p, a in good.items():
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside.get(p, 0) < percent * a or p not in inside:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def spoken(seed, n):
    """Texts with common phrases, line breaks, odd spaces and many languages."""
    rng = random.Random(seed)
    vocabulary = ["ab", "BA", "é", "x'y", "-", "ca", "da", "ÉL"]
    phrases = ["new york city", "x'y ab é ba", "one two three four five six"]
    texts = []
    for _ in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 4, 30)))]
        texts.append("".join(p + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "\x0b", " ? "]) for p in parts))
    return [(i, t, rng.choice(["en", "en", None, "und", "de", f"l{i % 40}"])) for i, t in enumerate(texts)]


@pytest.mark.parametrize("bits,least,percent", [(17, 3, 100), (16, 20, 60), (4, 5, 100), (20, 400, 100), (18, 70_000, 100)])
def test_collocations(spark, bits, least, percent):
    """Also with a table so small that every bucket is full."""
    rows = spoken(bits, 500) + [(-1, None, "en"), (-2, "", None), (-3, "ab ca " * 30_000, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "1 AS n", "'x' AS w1", "'y' AS phrase", "2 AS `a.b`").repartition(5)
    got = collocations.collocations(df, min_count=least, absorb_percent=percent, top=50, bits=bits).collect()
    assert sorted(map(tuple, got)) == plain_collocations([r[1:] for r in rows], least, percent, 50)


def test_windows_of_many_tasks_are_added_up_before_they_are_rows(spark, monkeypatch):
    """Every task meets every window: rows grow with the tasks and parts, and a window comes out once."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(" ".join(rng.choice(vocabulary, 60)), ("en", None)[i % 2]) for i in range(400)]
    texts = collocations._texts(spark.createDataFrame(rows, "text string, lang string").repartition(6), "text", "lang")
    often = np.full((collocations.ORDER << 16) // 8, 255, dtype=np.uint8)  # no window is cut short
    assert collocations.counted_windows(texts, often, 16).count() <= 6 * 2 * collocations.PARTS
    want = Counter()
    for text, lang in rows:
        words = text.split(" ")
        want.update((lang or "und", *(words[i:i + 5] + [None] * 4)[:5]) for i in range(len(words)))
    got = collocations.windows(texts, often, 16).collect()
    assert len(got) == len(want) > 20_000 and {tuple(r)[:-1]: r.n for r in got} == want
    monkeypatch.setattr(collocations, "HELD", 500)  # pieces of parts: the same sums, in more rows
    again = Counter()
    for r in collocations.windows(texts, often, 16).collect():
        again[tuple(r)[:-1]] += r.n
    assert again == want


def test_collocations_of_awkward_rows(spark):
    rows = documents()
    got = collocations.collocations(frame(spark, rows), min_count=4, bits=16).collect()
    assert sorted(map(tuple, got)) == plain_collocations([(r[1], r[2]) for r in rows], 4, 100, 2000)
    assert collocations.collocations(frame(spark, []), bits=16).count() == 0


def test_scores_beyond_64_bits(spark):
    """Counts of a very large corpus: the score is exact where its products need 100 bits."""
    a, n, l, r = 3 * 10**13 + 7, 10**16 + 3, 5 * 10**13 + 1, 4 * 10**13 + 9
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    df = df.select((collocations._wide(F.col("a")) * collocations._wide(F.col("n")) * F.lit(1000).cast("decimal(4,0)")).alias("x"),
                   (collocations._wide(F.col("l")) * collocations._wide(F.col("r"))).alias("y"))
    assert df.select(F.expr("x div y")).first()[0] == 1000 * a * n // (l * r)


def plain_vocabulary(rows, shortest, least, garble):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if garble and h % garble == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= shortest:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def plain_variants(words, ratio):
    out = {}
    for w, n in words.items():
        near = sorted(((-m, v) for v, m in words.items() if one_edit(w, v)))
        form = near[0][1] if near and -near[0][0] >= ratio * n else None
        out[w] = [form, None, n, len(near), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row[1] = root
    return {(w, *row) for w, row in out.items()}


def misspelt(seed, n):
    rng = random.Random(seed)
    base = ["possible", "Éléphant", "balançoires", "aaaaaaaa", "tÿpogra÷hie", "abcabcabc"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.choice((0, 3, 12))):
            w = rng.choice(base[:2]) if rng.random() < 0.7 else rng.choice(base)
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", rng.choice("abÿx")]) + w[at + rng.choice((0, 1)):]
            parts.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((rng.choice((i, i, None)), rng.choice((" ", "-", "1")).join(parts)))
    return rows


@pytest.mark.parametrize("symbols,garble", [(8, 31), (1, 0), (3, 2), (40, 5)])
def test_spelling_variants(spark, symbols, garble):
    """The alphabet's size decides who meets by chance, never the result; one symbol makes all of a length meet."""
    rows = misspelt(symbols, 400) + [(7, None), (8, ""), (9, "ab" * 3000), (10, "ab" * 3000), (11, "ab" * 2999 + "a"), (12, "ab" * 2999 + "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "5 AS n", "6 AS `a.b`").repartition(4)
    got = {tuple(r) for r in variants.spelling_variants(df, symbols=symbols, garble=garble, ratio=3).collect()}
    assert got == plain_variants(plain_vocabulary(rows, 7, 2, garble), 3)
    assert any(r[1] and r[2] != r[1] for r in got) or symbols != 8  # a chain of forms


def test_spelling_variants_of_awkward_rows(spark):
    rows = documents()
    got = {tuple(r) for r in variants.spelling_variants(frame(spark, rows), shortest=2).collect()}
    assert got == plain_variants(plain_vocabulary([(r[0], r[1]) for r in rows], 2, 2, 31), 10)
    assert variants.spelling_variants(frame(spark, [])).count() == 0


def test_long_texts_are_cut_outside_their_runs():
    text = "abcdefg " * 5 + "é" * 50 + "-" + "xyzabcd!" * 9
    for size in (1, 7, 30, 1000):
        parts = list(variants.parts_of(text, size))
        assert "".join(parts) == text
        assert [r for p in parts for r in re.findall("[a-zé]+", p)] == re.findall("[a-zé]+", text)


def test_neighbourhoods_are_complete():
    """Of two reduced strings at most one edit apart, one generates the other, however the work is cut in blocks."""
    words = [w for n in (1, 2, 3, 4) for w in np.ndindex(*(3,) * n)]
    for budget in (1, 50, 1 << 20):
        own, around = {}, defaultdict(set)
        for n in (1, 2, 3, 4):
            block = np.array([w for w in words if len(w) == n])
            for at, values, _ in variants.neighbourhoods(block, 3, budget):
                for i, value in zip(at.tolist(), values.tolist()):
                    assert value not in around[tuple(block[i].tolist())]  # each once
                    around[tuple(block[i].tolist())].add(value)
            for w in block:
                own[tuple(w.tolist())] = int(next(variants.neighbourhoods(w[None, :], 3))[1][0])
        assert len(set(own.values())) == len(words)
        for a in words:
            for b in words:
                near = a == b or one_edit("".join(map(str, a)), "".join(map(str, b)))
                assert near == (own[b] in around[a] or own[a] in around[b])


def floors(vector, scale):
    return [int(np.floor(np.float64(x) * scale)) for x in vector]


def plain_top(rows, k, scale=256.0, asks=lambda i: i % 3 == 0):
    limit = threshold.LONG
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = Counter()
    for i, v in rows:
        if asks(i):
            q = floors(v, scale)
            scored = sorted((-max(min(sum(a * b for a, b in zip(q, floors(w, scale))), limit), -limit), j) for j, w in rows if j != i and len(w) == len(v))
            out.update((i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1))
    return out


def vector_rows(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=6) * rng.choice((0.1, 1, 3)))]) for i in rng.permutation(n)]
    hot = rows[0][1]
    rows += [(n + i, hot) for i in range(n // 3)]  # a third of all rows is one vector
    rows += [(2 * n + i, [float(i % 2)] * 6) for i in range(30)]
    rows += [(5001, None), (5001, [1.0] * 6), (3, [1.0, float("nan")] * 3), (6, [None] * 6), (9, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(12, [0.0] * 6), (15, []), (16, []), (18, [1.0, 2.0]), (21, [2.0, 1.0]), (24, [5.0]), rows[2], rows[2], (27, [-1.0] * 6)]
    return rows


@pytest.mark.parametrize("shard,block", [(8192, 1024), (17, 5)])
def test_top_k(spark, shard, block):
    rows = vector_rows(shard, 120)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS score", "1 AS floor", "2 AS `a.b`", "3 AS shard")
    got = threshold.top_k(df, F.col("vec_id") % 3 == 0, shard_rows=shard, query_rows=block).collect()
    assert Counter(map(tuple, got)) == plain_top(rows, 5)


def test_top_k_of_huge_components_and_of_nothing(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([(1e30, 1), (-1e30, 2), (3e7, 5), (4e7, -5), (1e30, 1), (0.1, 0.2)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = threshold.top_k(df, F.col("vec_id") >= 0, shard_rows=2).collect()
    assert Counter(map(tuple, got)) == plain_top(rows, 5, asks=lambda i: True)
    assert threshold.top_k(df.limit(0), F.col("vec_id") >= 0).count() == 0
    assert threshold.top_k(df, F.col("vec_id") < 0).count() == 0


@pytest.mark.parametrize("shard", [8192, 7])
def test_threshold_search_counts_every_row(spark, tmp_path, shard):
    """A row that comes twice is two candidates of a query of the contract; rows with the query's id are its own."""
    rng = np.random.default_rng(shard)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=4))]) for i in range(101)]
    rows += rows[1:9] * 2 + rows[20:60] + [rows[50]] + [rows[70]] * 9
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    want = []
    for q in (0, 50, 100):
        scored = sorted((-sum(a * b for a, b in zip(floors(rows[q][1], 256.0), floors(v, 256.0))), i) for i, v in rows if i != q)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:5], 1)]
    got = threshold.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard, repeats=True).collect()
    assert sorted(map(tuple, got)) == want
    assert sorted(map(tuple, plans.op13_threshold_search(spark, str(tmp_path)).collect())) == want


def test_lists_stop_early():
    """On vectors of few directions the bound ends the reading long before the lists do."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.abs(rng.normal(size=(20000, 3)) ** 3))
    lists = threshold.Lists(x, np.arange(len(x)))
    seen = []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    lists.vectors = x.view(Watched)
    got = lists.best(x[5], 5, 5, None)
    scores = x @ x[5]
    scores[5] = -1
    assert [s for s, _ in got] == sorted(scores.astype(int), reverse=True)[:5]
    assert sum(seen) < 2000


def test_words_of_pieces():
    words = collocations.Words(pa.array(["a b, c", None, "d", "e\n", "f  g\th!i"]))
    assert words.left.tolist() == [2, 1, 1, 1, 1, 3, 2, 1, 1]
    assert words.first.tolist() == [0, 3, 3, 4, 5, 9]
    assert SCHEMA
