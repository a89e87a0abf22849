"""Trained scorers: gradients, held-out accuracy and awkward rows; the pipeline's stages against plain versions."""

from __future__ import annotations

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))
from cases import documents, frame  # noqa: E402

from clipmetrics.llm import gru, quality, randomindex, toxicity  # noqa: E402
from clipmetrics.llm.labels import fold  # noqa: E402

SMALL = "/root/testdata/sf0.01"


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    weights = {k: v.astype(np.float64) for k, v in gru.initial(50, 5, 4, 1).items()}
    vectors = np.concatenate([rng.standard_normal((9, 5)), np.zeros((1, 5))])
    words, labels = rng.integers(0, 10, (6, 7)), rng.integers(0, 2, 6).astype(float)
    words[0] = 9

    def loss():
        return gru.gradients(weights, vectors, words, labels, np.ones(6))[0]

    _, grads, dvectors = gru.gradients(weights, vectors, words, labels, np.ones(6))
    for array, grad in [*((weights[k], g) for k, g in grads.items()), (vectors[:9], dvectors[:9])]:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in array.shape)
            old = array[at]
            array[at] = old + 1e-3
            up = loss()
            array[at] = old - 1e-3
            down = loss()
            array[at] = old
            assert (up - down) / 2e-3 == pytest.approx(grad[at], abs=2e-5)


def test_windows_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 500])
    text, first, end = gru.windows(counts, 32, 24)
    base = np.cumsum(counts) - counts
    for t, n in enumerate(counts):
        mine = text == t
        covered = {w for a, b in zip(first[mine], end[mine]) for w in range(a, b)}
        assert covered == set(range(base[t], base[t] + n)) and mine.sum() >= 1


def labelled(n=500, seed=0):
    rng = random.Random(seed)
    stems = ["ka", "lo", "mi", "tu", "ra", "ne", "so", "vi"]
    rows = []
    for _ in range(n):
        ws = ["".join(rng.choice(stems) for _ in range(rng.choice((1, 2, 3)))) for _ in range(rng.choice((5, 40, 200)))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(2):
                ws[rng.randrange(len(ws))] = "zorgu" + rng.choice(stems)
        rows.append((" ".join(ws), int(toxic)))
    return rows


def test_toxicity_finds_unseen_inflections():
    scorer = toxicity.train(labelled(), rounds=4, steps=120)
    rows = labelled(300, 9)
    scores = scorer.scores(pa.array([t.replace("zorguka", "ZORGUpf,") for t, _ in rows]))
    labels = np.array([y for _, y in rows]) == 1
    assert (scores[labels] >= 0.7).mean() > 0.9 and (scores[~labels] >= 0.7).mean() < 0.03
    odd = scorer.scores(pa.array(["", None, " \n", "x" * 100_000]))
    assert ((odd >= 0) & (odd <= 1)).all() and (odd[:3] < 0.7).all()
    assert toxicity.train([("a b", 0)]).scores(pa.array(["a"]))[0] < 0.01


def test_fold_is_crc32(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, -3, 10**12, None)], "doc_id long")
    got = [r[0] for r in rows.select(fold(rows["doc_id"], 3)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 3 for i in (0, 7, -3, 10**12)] + [None]


def test_context_sums_are_the_plain_ones(spark):
    texts = ["Aa bb cc dd", "bb", None, "", "aa bb bb ## 12"]
    index, sums = randomindex.index_vectors(), np.zeros((randomindex.WORDS + randomindex.SHAPES, randomindex.WIDTH))
    for text in texts:
        words, shapes, _ = randomindex.tokens(pa.array([text]))
        for i in range(len(words)):
            for j in range(max(i - 2, 0), min(i + 3, len(words))):
                if i != j:
                    for name in (words[i], shapes[i]):
                        sums[name] += index[words[j]] + index[shapes[j]]
    norm = np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1)
    table = sums / norm
    want = np.where(norm > 1, table - table[norm[:, 0] > 1].mean(axis=0), 0)
    got = randomindex.contexts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose(got, want, atol=1e-6)
    assert not randomindex.contexts(spark.createDataFrame([], "text string")).any()


def test_quality_on_held_out_labels(spark):
    from clipmetrics.llm.plans import op5_quality

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = op5_quality(spark, SMALL).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and np.mean([p == y for p, y in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_scores_take_awkward_rows(spark):
    rows = documents()
    network = quality.train(np.zeros((randomindex.WORDS + randomindex.SHAPES, randomindex.WIDTH), np.float32), np.zeros((0, 96), np.float32), np.zeros(0, np.float32))
    scorer = toxicity.train([])
    for scored, model in ((quality.with_score, network), (toxicity.with_score, scorer)):
        got = scored(frame(spark, rows), model, score_col="own")
        assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in rows) and got.columns == [*frame(spark, rows).columns, "own"]
        assert scored(frame(spark, []), model, score_col="own").count() == 0
        with pytest.raises(ValueError):
            scored(frame(spark, rows), model)


def test_pipeline_stages(spark):
    """Each stage on what the one before kept: rows are never invented, and each decision takes effect."""
    import corpus_pipeline
    from clipmetrics.llm import exact, lexical, mixing, simhash
    from clipmetrics.session import written

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, last = {r.doc_id: r for r in docs.collect()}, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name == "packing":
            last = out
            break
        assert out.columns == docs.columns, name
        after = written(out, "test-stage")
        rows = after.collect()
        assert all(r == kept[r.doc_id] for r in rows)
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            clean = [i for i in kept if labels.get(i) == 0]
            assert sum(r.doc_id in set(clean) for r in rows) > 0.97 * len(clean) and len(rows) < len(kept)
        elif name == "exact dedup":
            want = {r.doc_id for r in exact.exact_classes(docs).collect() if r.kept}
            assert sorted(r.doc_id for r in rows) == sorted(want)
        elif name == "near dedup":
            want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert sorted(r.doc_id for r in rows) == sorted(want)
        else:
            want = Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})
            assert Counter(r.doc_id for r in rows) == want
        kept, docs = {r.doc_id: r for r in rows}, after
    got = Counter()
    for r in last.collect():
        got[r.doc_id] += r.length
    want = Counter()
    for r in lexical.pack_lexical(docs).collect():
        want[r.doc_id] += r.length
    assert got == want and set(got) == set(kept)
