"""Mixing, packing, neighbours and conversations against plain versions and round trips."""

from __future__ import annotations

import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from cases import documents, frame, words  # noqa: E402

from clipmetrics.llm import bins, lexical, mixing, neighbours, quotes, tokens  # noqa: E402


def shared_out(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing the excess again and again until none is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, fixed, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest = left - sum(most * sizes[s] for s in fixed)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in fixed else level * weight[s] for s in order}
        fixed |= set(over)


def test_mix(spark):
    rows = documents(n=90)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = shared_out(sizes)
    parameters = {"block_docs": 4, "fan_in": 2}  # many levels
    got = mixing.mix(frame(spark, rows), **parameters).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.copies in (0, 1, 2)
        assert r.taken == r.copies * r.size and (r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1) or r.size == 0)
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6 for s in want)
    again = mixing.mix(frame(spark, rows).repartition(5), **parameters).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix(frame(spark, [])).count() == 0
    whole = mixing.mixed(frame(spark, rows))
    assert whole.columns == frame(spark, rows).columns and 0 < whole.count() < 2 * len(rows)


def test_transfer_keeps_words_and_expectation():
    for p, s, q, t in ((0.3, 10, 0.6, 4), (0.5, 7, 0.5, 7), (0.9, 3, 0.2, 50)):
        ends = [mixing.transfer(p, s, q, t, u) for u in (0.0, 1 - 1e-12)]
        assert all(a * s + b * t == pytest.approx(p * s + q * t) and (a in (0, 1) or b in (0, 1)) for a, b in ends)
        up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        assert (down * ends[0][0] + up * ends[1][0]) / (up + down) == pytest.approx(p)


def reference_ids(texts):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokens.default_path()).encode
    return [[*encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_ids_are_those_of_the_vocabulary_file():
    odd = ["a<|endoftext|>b", "  two\n\n three\t", "don't WE'LL 12345 ½ …", "  x", "日本語 emoji 🙂🙂", "", None, "a" * 3000, " ".join(["lo ng"] * 4000)]
    for text, want in zip(odd, reference_ids(odd)):
        assert tokens.token_ids(text, tokens.default_path()).tolist() == want
        assert tokens.token_ids(text, tokens.default_path(), part=50).tolist() == want


def test_pieces_are_those_of_the_published_pattern():
    import tiktoken
    from public_tokenizers import PATTERN

    path, rng = tokens.default_path(), np.random.default_rng(4)
    own = tokens.encoder(path)
    assert own._pat_str == tokens.PIECES != PATTERN  # no branch of it goes back
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=own._mergeable_ranks, special_tokens=own._special_tokens)
    parts = ["a", "B", "é", "\u0301", "12", "½", " ", "  ", "\n", "\t", "\u2003", "\xa0", "\x1c", "'", "'s", "'LL", "'ll", "’s", "._-", "🙂", "日", "<|endoftext|>"]
    for n in rng.integers(0, 15, 3000):
        text = "".join(rng.choice(parts, n))
        got = tokens.token_ids(text, path)
        assert got.dtype == np.uint32 and got.tolist() == [*plain.encode(text, allowed_special="all"), 0], repr(text)


def test_terms_of_many_documents_at_once():
    rng = np.random.default_rng(5)
    for top, kind in ((300, np.uint16), (90_000, np.uint32)):
        ids = [np.append(rng.integers(0, top, n), 0).astype(kind) for n in (0, 50, 1, 0, 700)]
        for row, found in zip(ids, lexical.counted(ids)):
            terms, often = np.unique(row[:-1], return_counts=True)
            assert found.terms.tolist() == terms.tolist() and found.often.tolist() == often.tolist() and found.length == len(row)
    assert lexical.counted([]) == []


def test_sums_of_a_block_choose_what_exact_scores_choose():
    """Equal and nearly equal scores too; the sums of the likely next documents come with those of one."""
    rng = np.random.default_rng(6)
    ids = [np.append(rng.permutation(rng.integers(1, 90, n)), 0).astype(np.uint16) for n in rng.integers(1, 60, 500)]
    ids += [np.append(rng.permutation(row[:-1]), 0).astype(np.uint16) for row in ids[:60]]
    index, useful = lexical.Bm25(lexical.counted(ids)), np.ones(len(ids), dtype=bool)
    for keep in (None, rng.random(len(ids)) < 0.3):
        if keep is not None:
            useful = keep
            index.keep(useful)
        for doc in rng.choice(np.flatnonzero(useful), 40, replace=False).tolist():
            exact = index.scores(doc, np.arange(index.n))
            about, slack = index.about(doc, useful)
            assert index.ready and np.abs(about - exact).max() <= slack / 2
            got = [sorted(run.tolist()) for run in lexical.runs(about, 2, lambda at: index.scores(doc, at), slack)]
            assert got == [sorted(run.tolist()) for run in lexical.runs(exact)]


def test_best_fit_decreasing_is_the_plain_one():
    rng = np.random.default_rng(0)
    for window in (1, 8, 100, 1024):
        lengths = rng.integers(1, window + 1, 200)
        room, want = [], []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [(r, b) for b, r in enumerate(room) if r >= lengths[i]]
            b = min(fits)[1] if fits else len(room)
            if not fits:
                room.append(window)
                want.append([])
            room[b] -= lengths[i]
            want[b].append(int(i))
        assert bins.best_fit_decreasing(lengths, window) == want


@pytest.mark.parametrize("window", [64, 1024])
def test_pack_binary_round_trip(spark, window):
    rows = documents()
    ids = reference_ids([r[1] for r in rows])
    parts = defaultdict(list)
    for r in bins.pack_binary(frame(spark, rows), window=window, batch_bytes=20_000).collect():
        row, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(row) == len(places) == window and r.cu_lengths[-1] == r.n_tokens and len(r.doc_ids) == r.n_segments
        assert not row[r.n_tokens:].any()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_lengths, r.cu_lengths[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            parts[doc].append((start, row[a:b].tolist()))
    for doc in {r[0] for r in rows}:
        wanted = Counter((k, tuple(x[k:k + window])) for r, x in zip(rows, ids) if r[0] == doc for k in range(0, len(x), window))
        assert Counter((s, tuple(x)) for s, x in parts[doc]) == wanted
    assert bins.pack_binary(frame(spark, [])).count() == 0


def test_pack_lexical_round_trip(spark):
    rows = documents()
    ids = reference_ids([r[1] for r in rows])
    total = defaultdict(list)
    sequences = defaultdict(list)
    for r in lexical.pack_lexical(frame(spark, rows), window=128, batch_bytes=20_000).collect():
        piece = np.frombuffer(r.ids, "<u4").tolist()
        assert len(piece) == r.length > 0
        assert any(x[r.start:r.start + r.length] == piece and len(x) == r.doc_tokens for q, x in zip(rows, ids) if q[0] == r.doc_id)
        total[r.doc_id].append(r.length)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {d: sum(n) for d, n in total.items()} == {r[0]: sum(len(x) for q, x in zip(rows, ids) if q[0] == r[0]) for r in rows}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 128 and at & at - 1 == 0
    assert lexical.pack_lexical(frame(spark, [])).count() == 0


def test_windows_take_the_best_unused_neighbour():
    """Documents of two vocabularies: a window's neighbours share the seed's."""
    rng = np.random.default_rng(0)
    docs = [np.append(rng.integers(1 + 100 * (i % 2), 60 + 100 * (i % 2), 30), 0).astype(np.uint32) for i in range(40)]
    mixed = [len({n % 2 for n, _, _ in w}) for w in lexical.windows(docs, 124)]
    assert np.mean([m == 1 for m in mixed]) > 0.8


def bm25(ids):
    """Plain BM25 of every pair (seed, document), all terms counted."""
    found = [Counter(x[:-1].tolist()) for x in ids]
    df, n = Counter(t for f in found for t in f), len(ids)
    mean = sum(map(len, ids)) / n
    idf = {t: np.log1p((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    return lambda seed, d: sum(
        idf[t] * found[d][t] * 2.2 / (found[d][t] + 1.2 * (0.25 + 0.75 * len(ids[d]) / mean)) for t in found[seed] if t in found[d])


def test_windows_count_terms_of_many_documents():
    """A passage of 40 % of the documents and a group of copies: whoever follows a seed is the best unused by plain BM25."""
    rng = np.random.default_rng(2)
    passage = rng.integers(5000, 5200, 25)
    docs = []
    for i in range(100):
        own = rng.integers(1, 3000, int(rng.integers(10, 40)))
        docs.append(np.concatenate([own, passage if i % 5 < 2 else own[:0], [0]]).astype(np.uint32))
    docs += [docs[3]] * 25
    score, unused, seed, picks = bm25(docs), set(range(len(docs))), None, 0
    for segments in lexical.windows(docs, 100):
        for k, (number, start, _) in enumerate(segments):
            if start or k == 0:
                seed = number
            elif unused:
                best = max(score(seed, d) for d in unused)
                if best > 0:
                    assert score(seed, number) == pytest.approx(best)
                    picks += 1
                else:
                    seed = number
            unused.discard(number)
    assert picks > 50


def test_pack_lexical_does_not_depend_on_the_layout(spark):
    """Related documents lie far apart in the input; they meet, and another layout of the rows packs them alike."""
    rng = np.random.default_rng(4)
    letters = [["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(40)] for _ in range(8)]
    rows = [(i, " ".join(rng.choice(letters[i % 8], 60))) for i in range(640)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    packed = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
        packed.append(sorted(tuple(r) for r in lexical.pack_lexical(df, window=1024, batch_bytes=40_000).collect()))
    assert packed[0] == packed[1] and {r[0] for r in packed[0]} == {r[0] for r in rows}
    topics = defaultdict(set)
    for r in packed[0]:
        topics[r[5]].add(r[0] % 8 if r[0] < 1000 else 0)
    assert len({s >> 40 for s in topics}) > 5
    assert np.mean([len(t) == 1 for t in topics.values()]) > 0.6


def vectors(seed=0, n=400, d=12):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * rng.uniform(0.5, 2, (n, 1))
    x[50:250] = x[50]  # one very common vector
    return [(i, x[i].tolist()) for i in range(n)] + [
        (1000, None), (1001, []), (1002, [0.0] * d), (1003, [float("nan")] * d), (1004, [None] * d), (1005, [1.0, 2.0]), (None, x[0].tolist()), (1006, [float("inf")] * d)]


@pytest.mark.parametrize("shard", [8192, 40])
def test_nearest(spark, shard):
    rows = vectors()
    usable = {i: np.array(v) for i, v in rows if i is not None and i < 1000}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard=shard).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    x = np.array([np.array(v, dtype=np.float32).astype(float) for v in usable.values()])
    hits = total = 0
    for q in [i for i in usable if i % 20 == 0]:
        s = np.einsum("ij,j->i", x, x[q])
        order = [int(i) for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:20]
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        assert all(v == pytest.approx(s[i], abs=1e-12) for _, i, v in got[q])
        assert [(-v, i) for _, i, v in got[q]] == sorted((-v, i) for _, i, v in got[q])
        hits, total = hits + len(set(order) & {i for _, i, _ in got[q]}), total + 20
    assert hits / total >= 0.9 and set(got) == {i for i in usable if i % 20 == 0}


def test_nearest_of_few_vectors_finds_all(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(7)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [6, 5, 4, 3, 2, 1]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


TALK = [
    (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine, thanks."),
    (1, 2, "user", "On Monday somebody wrote:\n> > How are you?\n>  FINE,  thanks!\nGood to hear.\n\nBye"),
    (2, 0, "user", "> Good to hear.\nAgreed."), (2, 1, "assistant", "plain"), (2, 1, "assistant", "plain"),
    (None, 0, "user", ">x\nlost"), (3, None, None, None), (3, 0, "user", ">> never said"), (4, 0, "user", ""),
]


def test_quotes_lead_to_their_originals(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumn("message", F.lit(1))
    got = {(r.conv_id, r.turn): r for r in quotes.linked_messages(df).collect()}
    assert len(got) == 9
    parents = {k: (r.parent_conv, r.parent_turn, r.depth, r.thread_conv, r.linked, r.quotes) for k, r in got.items() if r.quotes}
    assert parents == {
        (1, 1): (1, 0, 1, 1, 1, 1), (1, 2): (1, 1, 2, 1, 2, 2), (2, 0): (1, 2, 3, 1, 1, 1), (None, 0): (None, None, 0, None, 0, 1),
        (3, 0): (None, None, 0, 3, 0, 1)}
    assert got[1, 2].content == "Good to hear.\n\nBye" and got[1, 2].quote_depth == 2
    rows = quotes.conversations(quotes.linked_messages(df)).collect()
    chats = {(r.thread_conv, r.conv_id, r.n_messages): r.chat for r in rows}
    assert chats[1, 1, 3] == "[user]\nHello there.\nHow are you?\n\n[assistant] @1:0\nFine, thanks.\n\n[user] @1:1\nGood to hear.\n\nBye"
    assert chats[1, 2, 1] == "[user] @1:2\nAgreed." and sum(r.n_messages for r in rows) == 9
    assert quotes.conversations(quotes.linked_messages(df.limit(0))).count() == 0


def test_conversations_agree_with_their_sql(spark):
    """On messages with nested, partial, repeated and foreign quotes, which the given tables lack."""
    import random

    import duckdb

    from clipmetrics.llm.plans import OP9_SQL

    rng = random.Random(2)
    said = [" ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(3)) for _ in range(12)]
    rows = []
    for conv in range(12):
        for turn in range(rng.randrange(1, 9)):
            parts = [rng.choice([f"{rng.choice(said)} {conv} {turn}", "> " + rng.choice(said) + f" {conv} {rng.randrange(4)}", ">> " + rng.choice(said),
                                 ">" + rng.choice(said).upper(), "", "On some day X wrote:", f"{rng.choice(said)}"]) for _ in range(rng.randrange(1, 6))]
            rows.append((conv, turn, rng.choice(["user", None]), "\n".join(parts)))
    rows += [rows[0], (None, 1, "user", "> x"), (3, None, "user", "a\n\n\n\nb"), (70, 130, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own = quotes.conversations(quotes.linked_messages(df))
    names = sorted(own.columns)
    base = duckdb.connect()
    base.register("conversations", df.toArrow())
    want = base.execute(OP9_SQL).fetchall()
    order = [d[0] for d in base.description]
    assert Counter(tuple(dict(zip(order, r))[n] for n in names) for r in want) == Counter(tuple(r[n] for n in names) for r in own.collect())
    assert sum(r.n_replies for r in own.collect()) > 10


def test_a_long_chain_of_replies(spark):
    rows = [(5, 0, "user", "start 0")] + [(5, i, "user", f"> start {i - 1}\nstart {i}") for i in range(1, 20)]
    got = {r.turn: r.depth for r in quotes.linked_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {i: i for i in range(20)}


def test_nearest_keeps_all_at_the_border(spark):
    """199 vectors of one product with the query: the smallest ids count, however many share the border."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, float(i), float(-i * i)]) for i in range(1, 200)]
    rows = rows[::-1]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") == 0, tables=1, success=0.999999).orderBy("rank").collect()
    assert {r.score for r in got} == {1.0}
    shard = pa.table({"bucket": [0] * 200, "id": [i for i, _ in rows], "vector": [v for _, v in rows]})
    asked = pa.table({"id": [0], "vector": [[1.0, 0.0, 0.0]], "buckets": [None]})
    found = neighbours._shard_search(21)(shard, pa.table({**{n: asked[n] for n in ("id", "vector")}, "buckets": pa.array([None], pa.list_(pa.int64()))}))
    assert sorted(found["id"].to_pylist()) == list(range(21))


def test_runs_come_best_first_and_ties_together():
    rng = np.random.default_rng(1)
    scores = rng.integers(-3, 40, 500) / 4
    got = [r.tolist() for r in lexical.runs(scores, 4)]
    assert [scores[r[0]] for r in got] == sorted({s for s in scores if s > 0}, reverse=True)
    assert all(sorted(r) == np.flatnonzero(scores == scores[r[0]]).tolist() for r in got)


def test_cuts_put_every_row_in_one_of_all_shards():
    """The tree deals a sample evenly, equal rows by their ties, and every row to the shard that walking it by hand gives."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, lexical.DIMENSIONS)).astype(np.float32)
    x[300:600] = x[300]
    tie = rng.integers(-2**62, 2**62, 900)
    cut = lexical.tree(x, tie, np.ones(900, dtype=np.int64), 7)
    shards = cut.shards(x, tie)
    assert set(shards) == set(range(7)) and np.bincount(shards).max() < 2.2 * 900 / 7
    for i in range(0, 900, 13):
        at = 0
        while at >= 0:
            place = float((x[i].astype(np.float64) * cut.axes[at]).sum())
            beyond = place > cut.cuts[at] + 1e-12 or (abs(place - cut.cuts[at]) <= 1e-12 and tie[i] > cut.ties[at])
            at = int(cut.children[at][int(beyond)])
        assert -1 - at == shards[i]
