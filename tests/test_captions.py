"""Order-dependent operators against plain sequential versions on random tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clipmetrics.functions import regions, similarity
from clipmetrics.operators import batches, boxes, captions, cues, media, ordered, shown, votes
from clipmetrics.params import CaptionParams, MatchParams, PackingParams, PersistentParams
from clipmetrics.session import written

TEXTS = ["hello world", "hello worlds", "hallo world", "good bye", "good-bye", "!!", "??", "欢迎光临", "欢迎光監", "x1 y2"]
OBS = "video_id string, ord long, t double, text string, confidence double"


def observations(seed, n=160, videos=3):
    rng = random.Random(seed)
    out, clock = [], dict.fromkeys(range(videos), 0.0)
    for i in range(n):
        v = rng.choice([0, 0, 0, *range(videos)])
        clock[v] = round(clock[v] + rng.choice([0.3, 0.3, 0.3, 0.6, 2.0]), 4)
        out.append((f"v{v}", i, clock[v], rng.choice(TEXTS[:3] + TEXTS), round(rng.random(), 3)))
    return out


@pytest.mark.parametrize("width", [1.0, 7.0, 1e6])
def test_sliced_scans_equal_plain_windows(spark, width):
    df = spark.createDataFrame(observations(1), OBS)
    order, keys = ["t", "ord"], ["video_id"]
    w = Window.partitionBy("video_id").orderBy("t", "ord")
    plain = df.select("ord", F.lag("text").over(w).alias("p"), F.max("confidence").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
                      F.sum((F.col("confidence") > 0.5).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"), F.row_number().over(w).cast("long").alias("n"))
    s = ordered.with_slices(df, F.col("t"), width)
    s = ordered.previous(s, keys, order, ["text"])
    s = ordered.running_max(s, keys, order, F.col("confidence"), "m")
    s = ordered.running_counts(s, keys, order, {"c": F.col("confidence") > 0.5})
    s = ordered.row_numbers(s, keys, order, "n")
    got = s.select("ord", F.col("prev_text").alias("p"), "m", "c", "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_previous_within_reach(spark):
    df = spark.createDataFrame(observations(2), OBS)
    w = Window.partitionBy("video_id").orderBy("t", "ord")
    near = F.when(F.col("t") - F.lag("t").over(w) <= 0.7, F.lag("text").over(w))
    want = {r.ord: r.p for r in df.select("ord", near.alias("p")).collect()}
    rows = ordered.previous_within(df, ["video_id"], ["t", "ord"], ["text", "t"], F.col("t"), 2.0, 0.7).collect()
    assert len(rows) == df.count()
    assert {r.ord: (r.prev_text if r.prev_t is not None and r.t - r.prev_t <= 0.7 else None) for r in rows} == want


def segments_one_by_one(rows, params):
    """Sequential segmentation: text stays while it resembles the segment's shown text and no gap occurs."""
    out = []
    for video in sorted({r[0] for r in rows}):
        open_ = None
        for _, ord_, t, text, conf in sorted(r for r in rows if r[0] == video):
            same = open_ is not None and t - open_["last"] <= params.gap and similarity.ratio(similarity.comparable(open_["text"]), similarity.comparable(text)) >= params.text_similarity
            if not same:
                open_ = {"video": video, "ords": [], "text": text, "conf": round(conf, 4)}
                out.append(open_)
            elif conf > open_["conf"]:
                open_["text"], open_["conf"] = text, round(conf, 4)
            open_["ords"].append(ord_)
            open_["last"] = t
    return sorted((s["video"], tuple(s["ords"])) for s in out)


def without_pause(seed, n, texts, trust):
    """One video that never pauses; texts change now and then, so that one may be shown for many slices or few."""
    rng, out, kind = random.Random(seed), [], 0
    for i in range(n):
        kind = rng.randrange(len(texts)) if rng.random() < 0.04 else kind
        out.append(("v", i, round(i * 0.3, 4), rng.choice(texts[kind]), trust(rng)))
    return out


@pytest.mark.parametrize("seed,trust", [(1, lambda r: round(r.random(), 3)), (2, lambda r: r.choice([0.5, 0.9, 0.9])), (3, lambda r: 0.8), (4, lambda r: round(r.random() ** 4, 5))])
@pytest.mark.parametrize("width", [0.9, 6.0])
def test_similar_segments_over_slices(spark, seed, trust, width):
    """A text that outlasts many slices, drifting spellings and texts near the threshold: as if folded in one go."""
    drift = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx", "abcvwzyx"]
    rows = without_pause(seed, 700, [drift, ["hello world", "hello worlds"], ["good bye"], ["!!", "good-bye"]], trust)
    params = CaptionParams(max_gap=0.75, slice_seconds=width)
    got = captions.similar_text_segments(spark.createDataFrame(rows, OBS), params).groupBy("video_id", "seg").agg(F.sort_array(F.collect_list("ord")).alias("o")).collect()
    assert sorted((r.video_id, tuple(r.o)) for r in got) == segments_one_by_one(rows, params)


def test_one_text_over_all_slices_takes_few_rounds(spark):
    """Equally trusted readings of one text that never pauses: guessed right at once, so two walks settle 200 slices."""
    rows = [("v", i, i * 0.3, "hello world" + "s" * (i % 2), 0.9) for i in range(2000)]
    runs = spark.createDataFrame([(v, 1, i, t, x, c) for v, i, t, x, c in rows], "video_id string, island long, run long, t double, cmp string, best double")
    jobs = []
    plain = shown.written
    shown.written = lambda df, name: jobs.append(name) or plain(df, name)
    try:
        parts = shown.segment_parts(runs, similarity.ratio_from, 0.7, 3.0)
    finally:
        shown.written = plain
    assert [(r.part, r.n) for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()] == [(0, 2000)]
    assert jobs.count("slice-entries") == 2


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_similar_segments(spark, seed):
    rows = observations(seed)
    rows = [(v, i, t, x, c) for i, (v, _, t, x, c) in enumerate(sorted(rows, key=lambda r: (r[0], r[2], r[1])))]
    params = CaptionParams(max_gap=0.75, slice_seconds=3.0)
    got = captions.similar_text_segments(spark.createDataFrame(rows, OBS), params).groupBy("video_id", "seg").agg(F.sort_array(F.collect_list("ord")).alias("o")).collect()
    assert sorted((r.video_id, tuple(r.o)) for r in got) == segments_one_by_one(rows, params)


def vote_one_by_one(items, threshold):
    """Consensus over single observations (text, confidence, ord) in order."""
    sim = lambda a, b: similarity.ratio(similarity.comparable(a), similarity.comparable(b))
    groups = []
    for item in items:
        scored = [(max(sim(item[0], other[0]) for other in g), -n) for n, g in enumerate(groups)]
        top = max(scored, default=(-1, 0))
        if top[0] >= threshold:
            groups[-top[1]].append(item)
        else:
            groups.append([item])
    best = max(groups, key=lambda g: (len(g), round(sum(i[1] for i in g), 9)))
    rank = lambda i: (sum(sim(i[0], o[0]) for o in best if o is not i) / (len(best) - 1) if len(best) > 1 else 1.0) * 0.82 + i[1] * 0.18
    shown = max(best, key=lambda i: round(rank(i), 9))
    return shown[0], round(sum(i[1] for i in best) / len(best), 6), len(best), len(items), shown[2]


@pytest.mark.parametrize("seed", [21, 22])
def test_consensus(spark, seed):
    rows = observations(seed, 220, 6)
    got = captions.consensus(spark.createDataFrame(rows, OBS), ["video_id"]).collect()
    for r in got:
        items = [(x[3], x[4], x[1]) for x in rows if x[0] == r.video_id]
        assert (r.text, round(r.confidence, 6), r.winner_count, r.observation_count, r.representative_ord) == vote_one_by_one(items, 0.72)


def test_consensus_prefers_agreement_over_one_confident_reading(spark):
    rows = [("v", 0, 0.0, "欢迎来到直播间", 0.76), ("v", 1, 0.3, "完全不同的字", 0.98), ("v", 2, 0.6, "欢迎来到直播间", 0.79)]
    r = captions.consensus(spark.createDataFrame(rows, OBS), ["video_id"]).first()
    assert (r.text, r.winner_count, round(r.consensus_score, 4)) == ("欢迎来到直播间", 2, 0.6667)
    assert captions.consensus(spark.createDataFrame([("v", 0, 0.0, " ", 0.9)], OBS), ["video_id"]).count() == 0


def test_consensus_as_aggregate_function(spark):
    df = spark.createDataFrame(observations(23, 150, 5), OBS)
    captions.register_consensus(spark)
    df.createOrReplaceTempView("obs")
    by_sql = {r.video_id: r.t for r in spark.sql("select video_id, consensus_text(text, confidence, ord) as t from obs group by video_id").collect()}
    assert by_sql == {r.video_id: r.text for r in captions.consensus(df, ["video_id"]).collect()}


def test_final_segments(spark):
    rows = [("v", i, i * 0.3, "label text", 0.9) for i in range(60)] + [("v", 100 + i, 30 + i * 0.3, "caption", 0.9) for i in range(3)] + [("v", 200, 50.0, "blink", 0.9)]
    params = CaptionParams(interval=0.3, persistent_seconds=12.0)
    out = captions.finalize(captions.similar_text_segments(spark.createDataFrame(rows, OBS), params), params).collect()
    assert [(r.seg_id, r.text, r.observation_count) for r in out] == [(0, "caption", 3)]


def test_uncertain_and_refined(spark):
    low = spark.createDataFrame([(0.71, 0.9, 3), (0.9, 0.6, 3), (0.9, 0.9, 1), (0.72, 0.67, 2)], "c double, s double, n long")
    assert [r.u for r in low.select(captions.uncertain(F.col("c"), F.col("s"), F.col("n")).alias("u")).collect()] == [True, True, True, False]
    schema = "video_id string, seg_id long, start_s double, end_s double, text string, confidence double, consensus_score double, observation_count long, winner_count long"
    segs = spark.createDataFrame([("v", 0, 0.0, 10.0, "old", 0.5, 0.5, 4, 2), ("v", 1, 20.0, 30.0, "sure", 0.9, 0.9, 4, 4), ("v", 2, 40.0, 50.0, "kept", 0.6, 0.9, 4, 4)], schema)
    fine = spark.createDataFrame([("v", 1, 2.2, "new", 0.8), ("v", 2, 5.1, "new", 0.9), ("v", 3, 5.15, "far", 0.9), ("v", 4, 7.8, "other", 0.4), ("v", 5, 25.0, "x", 0.9), ("v", 6, 42.2, "aaa", 0.55), ("v", 7, 45.0, "bbb", 0.56)], OBS)
    rows = {r.seg_id: r for r in captions.refine(segs, fine, CaptionParams()).collect()}
    assert (rows[0].text, rows[0].confidence, rows[0].winner_count, rows[0].refined) == ("new", 0.85, 2, True)
    assert (rows[1].text, rows[1].refined) == ("sure", False) and (rows[2].text, rows[2].refined) == ("kept", False)


def test_recovery_only_for_empty_videos(spark):
    rows = [("a", 1, 0.0, "first", 0.7), ("a", 2, 1.0, "weak", 0.6), ("b", 3, 0.0, "weak", 0.6), ("c", 4, 0.0, "lost", 0.5)]
    segment = lambda df, p: captions.equal_text_segments(df, p)
    out = captions.recover_empty(spark.createDataFrame(rows, OBS), segment, CaptionParams(min_confidence=0.65))
    assert sorted((r.video_id, r.text) for r in out.collect()) == [("a", "first"), ("b", "weak")]


def shared(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h / max(1e-9, min(a[2] * a[3], b[2] * b[3])) if w > 0 and h > 0 else 0.0


@pytest.mark.parametrize("seed", [31, 32])
def test_overlap_groups(spark, seed):
    rng = random.Random(seed)
    rows = [(f"v{rng.randrange(3)}", i, rng.randrange(10) / 10, rng.randrange(10) / 10, rng.randrange(1, 4) / 10, rng.randrange(1, 4) / 10) for i in range(120)]
    df = spark.createDataFrame(rows, "video_id string, item long, x double, y double, w double, h double")
    got = {(r.video_id, r.item): r.grp for r in boxes.overlap_groups(df, ["video_id"]).collect()}
    for v in {r[0] for r in rows}:
        groups = []
        for r in (r for r in rows if r[0] == v):
            n = next((i for i, g in enumerate(groups) if max(shared(r[2:], o) for o in g) >= 0.28), len(groups))
            if n == len(groups):
                groups.append([])
            groups[n].append(r[2:])
            assert got[v, r[1]] == n


def test_cleanup_regions(spark):
    rows = [("v", 1, 0.1, 0.7, 0.2, 0.1), ("v", 2, 0.11, 0.7, 0.2, 0.1), ("v", 3, 0.6, 0.1, 0.2, 0.1), ("v", 4, 0.5, 0.5, 0.0005, 0.2)]
    out = boxes.cleanup_regions(spark.createDataFrame(rows, "video_id string, item long, x double, y double, w double, h double"), ["video_id"]).orderBy("region_no").collect()
    assert [(r.x, r.y, r.w, r.h) for r in out] == [(0.59, 0.092, 0.22, 0.116), (0.09, 0.692, 0.23, 0.116)]


def test_detection_clusters(spark):
    rows = [("v", i, 0.4 + i / 1000, 0.2, 0.1, 0.1) for i in range(4)] + [("v", 9, 0.8, 0.8, 0.1, 0.1)]
    frames = spark.createDataFrame([("v", 12)], "video_id string, frame_count long")
    out = boxes.cluster_detections(spark.createDataFrame(rows, "video_id string, item long, x double, y double, w double, h double"), frames, ["video_id"]).collect()
    assert [(r.hits, round(r.confidence, 4), round(r.box.x, 6)) for r in out] == [(4, round(0.55 + 4 / 12 * 0.35, 4), 0.3765)]


def test_persistent_region(spark):
    schema = "video_id string, ord long, sample long, side string, x double, y double, w double, h double, text string, confidence double"
    right = [("r", i, i, "right", 0.82, 0.05, 0.12, 0.04, "logo", 0.8) for i in range(5)] + [("r", 9, 0, "left", 0.02, 0.05, 0.1, 0.04, "noise", 0.9)]
    left = [("l", i, i, "left", 0.02, 0.05, 0.1, 0.04, "logo", 0.8) for i in range(5)]
    single = [("s", 1, 1, "left", 0.02, 0.05, 0.1, 0.04, "once", 0.9)]
    brand = [("b", 1, 1, "left", 0.02, 0.05, 0.1, 0.04, "BiliBili", 0.9)]
    df = spark.createDataFrame(right + left + single + brand, schema)
    samples = df.select("video_id").distinct().withColumn("sample_count", F.lit(5))
    rows = {r.video_id: r for r in boxes.persistent_region(df, samples, PersistentParams()).collect()}
    assert {k: (r.side, r.hits) for k, r in rows.items()} == {"r": ("right", 5), "l": ("left", 5), "b": ("left", 1)}
    assert rows["r"].confidence == 1.0 and 0.0 <= rows["r"].region.x <= 1 - rows["r"].region.w
    texts = boxes.persistent_texts(df, spark.createDataFrame([("r", "right")], "video_id string, side string")).collect()
    assert texts[0].texts == ["logo"] * 5
    once = spark.createDataFrame([("r", 20, 3, "right", 0.5, 0.9, 0.1, 0.04, "passing", 0.8)], schema)
    again = boxes.persistent_texts(df.unionByName(once), spark.createDataFrame([("r", "right")], "video_id string, side string")).collect()
    assert again[0].texts == ["logo"] * 5  # a text outside the persistent cells does not count


def test_refined_segments_take_the_finer_geometry(spark):
    segs = spark.createDataFrame(
        [("v", 0, 0.0, 10.0, "old", 0.4, 0.4, 1, 1, 1, 1), ("v", 1, 20.0, 30.0, "sure", 0.9, 1.0, 5, 5, 2, 3)],
        "video_id string, seg_id long, start_s double, end_s double, text string, confidence double, consensus_score double, observation_count long, winner_count long, representative_ord long, first_ord long")
    box = lambda x: [(x, 0.8, 0.1, 0.05)]
    kind = "video_id string, ord long, t double, text string, confidence double, boxes array<struct<x:double,y:double,w:double,h:double>>"
    coarse = spark.createDataFrame([("v", 1, 0.0, "old", 0.4, box(0.1)), ("v", 2, 25.0, "sure", 0.9, []), ("v", 3, 20.0, "sure", 0.9, box(0.3))], kind)
    fine = spark.createDataFrame([("v", 1, 2.2, "new", 0.9, box(0.5)), ("v", 2, 5.0, "new", 0.8, box(0.6)), ("v", 3, 7.8, "x", 0.6, box(0.7))], kind)
    refined = captions.refine(segs, fine, CaptionParams())
    rows = {r.seg_id: r for r in captions.with_geometry(refined, coarse, fine=fine).collect()}
    assert (rows[0].text, rows[0].refined_ord, rows[0].representative_ord) == ("new", 1, 1) and rows[0].bbox.x == pytest.approx(0.488)
    assert (rows[1].text, rows[1].refined_ord) == ("sure", None) and rows[1].bbox.x == pytest.approx(0.288)  # the first observation's box


def test_cleanup_of_winners_leaves_other_texts_out(spark):
    kind = "video_id string, ord long, t double, text string, confidence double, boxes array<struct<x:double,y:double,w:double,h:double>>"
    box = lambda x: [(x, 0.8, 0.1, 0.05)]
    rows = [("v", i, i / 3.0, "caption one", 0.9, box(0.2)) for i in range(5)] + [("v", 5, 5 / 3.0, "captoin one", 0.9, box(0.21)), ("v", 9, 1.5, "", 0.9, box(0.7))]
    params = CaptionParams()
    numbered = captions.similar_text_segments(captions.accept(spark.createDataFrame(rows, kind), params), params)
    out = captions.cleanup_of_winners(captions.finalize(numbered, params), numbered).collect()
    assert len(out) == 1 and out[0].x == pytest.approx(0.19) and out[0].w == pytest.approx(0.13)


def test_bounded_ratio_loses_no_pair():
    import random

    from clipmetrics.functions.similarity import ratio, ratio_from

    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(9))) for _ in range(60)]
    for a in words:
        for b in words:
            for floor in (0.3, 0.72, 0.9):
                assert ratio_from(a, b, floor) == (ratio(a, b) if ratio(a, b) >= floor else 0.0)


def test_sketches_merge_and_keep_their_bound(spark):
    """40,000 boxes of one key in parts of unequal size: ranks within 0.5 %, whatever the parts; few boxes as the exact form."""
    df = spark.range(40_000).selectExpr("'k' as key", "cast(sqrt(id) as long) as part", "pmod(id * 7919, 40000) / 50000d as x", "pmod(id * 104729, 40000) / 60000d as y", "0.1d as w", "0.05d as h")
    parts = boxes.edge_sketches(df, ["key", "part"], unit="part")
    got = boxes.sketched_quantiles(boxes.merge_sketches(parts, ["key"]), ["key"], 0.05, 0.95).first()
    assert got.boxes == 40_000 and abs(got.units - 200) <= 4
    assert abs(got.l - 0.05 * 0.8) <= 0.005 * 0.8 and abs(got.r - 0.1 - 0.95 * 0.8) <= 0.005 * 0.8
    assert abs(got.t - 0.05 * 2 / 3) <= 0.005 * 2 / 3 and abs(got.b - 0.05 - 0.95 * 2 / 3) <= 0.005 * 2 / 3
    few = df.where("x <= 0.0102")  # an odd number of boxes has its median among them
    sketched, exact = boxes.robust_box_of(boxes.edge_sketches(few, ["key"]), ["key"]), boxes.robust_box(few, ["key"])
    assert few.count() % 2 == 1 and sketched.collect() == exact.collect()
    assert boxes.text_region_of(boxes.edge_sketches(df.limit(0), ["key"]), ["key"]).collect() == []


def test_boxes_without_area_stay_apart(spark):
    rows = [("v", i, 0.5, 0.5, w, 0.1) for i, w in enumerate((0.0, 0.0, 0.2, 0.2))]
    got = boxes.overlap_groups(spark.createDataFrame(rows, "video_id string, item long, x double, y double, w double, h double"), ["video_id"], 0.25, True, 1e-6)
    assert [r.grp for r in got.orderBy("item").collect()] == [0, 1, 2, 2]


def test_caption_lines_prefer_the_coherent_caption(spark):
    schema = "video_id string, frame long, det long, x double, y double, w double, h double, text string, confidence double"
    rows = [("v", 0, 1, 20.0, 40.0, 60.0, 30.0, "AD", 0.95), ("v", 0, 2, 200.0, 800.0, 300.0, 40.0, "这是第一行字幕", 0.9), ("v", 0, 3, 520.0, 805.0, 300.0, 40.0, "接着后半句", 0.9),
            ("v", 0, 4, 200.0, 870.0, 600.0, 40.0, "这是第二行字幕内容", 0.9), ("v", 1, 5, 1.0, 1.0, 5.0, 5.0, "only", 0.9)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.det for r in captions.caption_lines(df, 1000.0, 1000.0).collect()) == [2, 3, 4, 5]
    texts = {r.frame: r.text for r in captions.frame_texts(captions.caption_lines(df, 1000.0, 1000.0), 1000.0, 1000.0).collect()}
    assert texts == {0: "这是第一行字幕 接着后半句 这是第二行字幕内容", 1: "only"}


def test_placement_zones(spark):
    videos = spark.createDataFrame([("a", 1080, 1920, None, None), ("b", 1920, 1080, None, None), ("c", 1080, 1920, (0.1, 0.8, 0.8, 0.1), 0.7)],
                                   "video_id string, width int, height int, source_region struct<x: double, y: double, w: double, h: double>, source_confidence double")
    protected = spark.createDataFrame([("a", "face", 0.1, 0.73, 0.8, 0.1)], "video_id string, kind string, x double, y double, w double, h double")
    rows = {r.video_id: r for r in boxes.place_captions(videos, protected).collect()}
    assert (rows["a"].zone, rows["a"].anchor_y) == (2, round(0.49 + 0.15 * 0.58, 5))
    assert (rows["b"].zone, rows["b"].anchor_y) == (0, round(0.74 + 0.15 * 0.58, 5))
    assert (rows["c"].reason, rows["c"].zone) == ("replace_source_subtitle", None)


CUE = "video_id string, ord long, start_s double, end_s double"


@pytest.mark.parametrize("seed", [41, 42])
def test_interval_merge(spark, seed):
    rng = random.Random(seed)
    rows = [(f"v{rng.randrange(2)}", i, s := round(rng.random() * 60, 2), round(s + rng.choice([0.2, 0.5, 9.0]), 2)) for i in range(80)]
    got = sorted((r.video_id, r.start_s, r.end_s) for r in cues.merge_intervals(spark.createDataFrame(rows, CUE), slice_seconds=2.0).collect())
    want = []
    for v in ("v0", "v1"):
        merged = []
        for _, _, s, e in sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[1])):
            if merged and s - merged[-1][1] <= 0.30:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want += [(v, s, e) for s, e in merged]
        assert all(b[0] - a[1] > 0.30 for a, b in zip(merged, merged[1:]))
    assert got == want


@pytest.mark.parametrize(("seed", "width", "steps"), [(7, 5.0, (0.0, 0.5, 1.0, 1.5)), (8, 11.0, (0.0, 0.1)), (9, 600.0, (0.0, 3.0)), (10, 10.0, (0.0, 25.0)), (11, 12.0, (-0.4, 0.0))])
def test_speech_packing(spark, seed, width, steps):
    """Slices of any width give the groups of one pass over each video: stretches without pauses, overlaps, empty slices."""
    rng = random.Random(seed)
    rows = []
    for video in "vwx":
        clock = -3.0
        for i in range(150):
            clock = round(clock + rng.choice(steps), 2)
            rows.append((video, i, clock, clock := round(clock + rng.choice([0.5, 2.0, 0.1]), 2), "x" * rng.choice((0, 5, 20, 79, 300) if video == "x" else (3, 40))))
    rows += [("y", i, 4.0, 4.0 + i % 3, "same") for i in range(50)] + [("z", 1, 8.0, 60.0, "long"), ("z", 2, 59.0, 61.0, "b"), ("z", 3, 61.0, 60.0, "c")]
    df = spark.createDataFrame(rows, CUE + ", text string").repartition(3)
    got = [(r.video_id, r.first_ord, r.start_s, r.end_s, r.cues, r.text) for r in cues.pack_speech(df, PackingParams(), width).collect()]
    want = []
    for v, i, s, e, t in sorted((r for r in rows if r[4]), key=lambda r: (r[0], r[2], r[1])):
        w = want[-1] if want and want[-1][0] == v else None
        if w and len(w[5]) + 1 + len(t) <= 180 and max(s, e) - w[2] <= 10 and s - w[3] <= 1.2:
            want[-1] = (*w[:3], e, w[4] + 1, w[5] + " " + t)
        else:
            want.append((v, i, s, e, 1, t))
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("seed", [51, 52])
def test_text_split(spark, seed):
    import re

    rng = random.Random(seed)
    parts = ["word ", "a, ", "句子。", "Long" * 30, " ", "end. ", "x! ", "mid "]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(40)]

    def up(pieces, limit):
        out, cur = [], ""
        for p in pieces:
            both = f"{cur} {p}".strip()
            if cur and len(both) > limit:
                out.append(cur)
                cur = p
            else:
                cur = both
        return [c for c in [*out, cur] if c]

    def split(value, limit):
        value = " ".join(value.split())
        if len(value) <= limit:
            return [value] if value else []
        flat = []
        for s in (p.strip() for p in re.split(r"(?<=[.!?。！？;；:：,，])\s*", value)):
            words = s.split()
            flat += [] if not s else [s] if len(s) <= limit else up(words, limit) if len(words) > 1 else [s[i:i + limit] for i in range(0, len(s), limit)]
        return up(flat, limit)

    rows = cues.split_long_texts(spark.createDataFrame(texts, "id int, text string"), ["id"], "text", 60).orderBy("id", "piece_no").collect()
    for i, t in texts:
        assert [r.piece for r in rows if r.id == i] == split(t, 60)


@pytest.mark.parametrize("seed", [61, 62])
def test_cue_matching_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    span = lambda: (s := round(rng.random() * 100, 1), round(s + rng.choice([0.4, 1.0, 30.0]), 1))
    c = [("v", i, *span()) for i in range(60)] + [("v", 100, 5.0, 6.0), ("v", 101, 5.0, 6.0), ("w", 102, 1.0, 2.0)]
    s = [("v", i, *span()) for i in range(25)] + [("v", 50, 5.0, 6.0), ("v", 49, 5.0, 6.0), ("v", 60, 9.0, 9.0)]
    got = {r.ord: r.seg_id for r in cues.match_cues(spark.createDataFrame(c, CUE), spark.createDataFrame(s, CUE.replace("ord", "seg_id")), MatchParams(bucket_seconds=3.0)).collect()}
    for v, i, a, b in c:
        usable = [x for x in s if x[0] == v and x[3] > x[2]]
        best = min(usable, key=lambda x: (-max(0.0, min(b, x[3]) - max(a, x[2])), x[1]), default=None)
        if best is not None and min(b, best[3]) - max(a, best[2]) <= 0:
            near = min(usable, key=lambda x: (abs((a + b) / 2 - (x[2] + x[3]) / 2), x[1]))
            best = near if abs((a + b) / 2 - (near[2] + near[3]) / 2) <= 1.5 else None
        assert got[i] == (best[1] if best else None), (i, a, b)


def test_cue_placement(spark):
    schema = CUE.replace("ord", "seg_id") + ", bbox struct<x: double, y: double, w: double, h: double>, placement string"
    segs = spark.createDataFrame([("v", 0, 0.0, 1.0, (0.4, 0.8, 0.1, 0.05), "bottom"), ("v", 1, 2.0, 3.0, (0.1, 0.1, 0.1, 0.05), "")], schema)
    lines = spark.createDataFrame([("v", 0, 0.2, 0.9), ("v", 1, 3.5, 4.5), ("v", 2, 90.0, 91.0), ("none", 3, 0.0, 1.0)], CUE)
    rows = {r.ord: r for r in cues.place_cues(lines, segs).collect()}
    assert rows[0].bottom and abs(rows[0].region.w - 0.24) < 1e-9 and abs(rows[0].region.x - 0.33) < 1e-9
    assert rows[1].seg_id == 1 and not rows[1].bottom and rows[1].region.w == 0.1
    assert not rows[2].matched and rows[2].bottom and not rows[3].matched


def test_batches_and_bisection(spark):
    rows = [("v", i, float(i), float(i) + 0.5, f"line {i}") for i in range(11)]
    df = spark.createDataFrame(rows, CUE + ", text string")
    made = batches.context_batches(df, PackingParams(batch_size=4, context=3), 2.0).orderBy("batch_no").collect()
    assert [[i.id for i in r["items"]] for r in made] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10]]
    assert [[i.id for i in r.before] for r in made] == [[], [1, 2, 3], [5, 6, 7]] and [[i.id for i in r.after] for r in made] == [[4, 5, 6], [8, 9, 10], []]
    wide = batches.context_batches(df, PackingParams(batch_size=2, context=3)).orderBy("batch_no").collect()
    assert [i.id for i in wide[2].before] == [1, 2, 3] and [i.id for i in wide[2].after] == [6, 7, 8]

    def moody(items, context):
        if any(i["id"] == 6 for i in items):
            raise ValueError("no")
        return [{"id": i["id"], "text": "这是原文没有翻译" if i["id"] == 2 and len(items) > 1 else f"t{i['id']}"} for i in items if not (i["id"] == 9 and len(items) > 2)]

    chinese = df.withColumn("text", F.lit("这是原文没有翻译"))
    out = batches.with_bisection(batches.context_batches(chinese, PackingParams(batch_size=4)), moody, batch_size=4)
    got = {r.id: (r.text, r.error) for r in out.collect()}
    assert got == {i: (None, "no translation") if i == 6 else (f"t{i}", None) for i in range(11)}


@pytest.mark.parametrize(("response", "want"), [
    ({"translations": [{"id": 1, "vi": " a "}, {"id": 2, "translation": "b"}]}, {1: "a", 2: "b"}), (["x", "y"], {1: "x", 2: "y"}),
    ([{"text": "x"}, {"text": ""}], {1: "x"}), ({"id": 2, "text": "only"}, {2: "only"}),
])
def test_loose_responses(response, want):
    assert batches.normalize_response(response, [{"id": 1, "text": "p"}, {"id": 2, "text": "q"}]) == want


@pytest.mark.parametrize("response", [{"other": 1}, ["x"], [{"text": "x"}], [3, 4], "one", {"translations": []}])
def test_unusable_responses(response):
    with pytest.raises(ValueError):
        batches.normalize_response(response, [{"id": 1, "text": "p"}, {"id": 2, "text": "q"}])


def test_untranslated_guard(spark):
    rows = [(1, "欢迎来到直播间", "欢迎 来到直播间"), (2, "欢迎来到直播间今天", "欢迎来到直播间今天吧 ok"), (3, "欢迎来到直播间", "Chào mừng bạn"), (4, "小米", "小米"), (5, "欢迎来到", "")]
    df = spark.createDataFrame(rows, "id long, source_text string, target_text string")
    assert [r.id for r in batches.untranslated(df).collect()] == [1, 2]
    assert batches.bad_id_lists(df, F.lit(0)).first().bad_ids == "1,2"


def test_rendition_geometry(spark):
    rows = {r.aspect: r for r in media.plan_renditions(spark.createDataFrame([(1920, 1080)], "width int, height int")).collect()}
    assert rows["16:9"].action == "copy" and rows["9:16"].action == "blur_fill" and rows["3:4"].action == "crop"
    assert rows["3:4"].retention == 0.421875
    assert (rows["3:4"].crop_w, rows["3:4"].crop_h, rows["3:4"].crop_y) == (810, 1080, 0) and rows["3:4"].crop_x > 0


def test_stream_choice(spark):
    rows = [("v", 0, "video/mp4", 100, 0, 2160), ("v", 1, "video/mp4", 90, 0, 720), ("v", 2, "video/mp4", 95, 0, 720), ("v", 3, "audio/mp4", 5, 0, 0), ("v", 4, "audio/mp4", 5, 0, 0), ("v", 5, "video/mp4", 7, 0, 0),
            ("w", 0, "video/mp4", 9, 0, 2160), ("w", 1, "video/mp4", 9, 0, 1440), ("w", 2, "video/mp4", 9, 0, 1440)]
    out = {r.video_id: (r.video_idx, r.audio_idx, r.combined_idx) for r in media.pick_streams(spark.createDataFrame(rows, "video_id string, idx int, mime string, bandwidth long, width int, height int")).collect()}
    assert out == {"v": (2, 3, 5), "w": (1, None, None)}


def test_stage_cascade(spark):
    config = {"a": ["x"], "b": ["y"], "c": ["z"]}
    old = spark.createDataFrame([(1, "x", "y", "z"), (2, "x", "y", "z"), (3, "x", "y", "z")], "item_id int, x string, y string, z string")
    new = spark.createDataFrame([(1, "x", "y", "z"), (2, "x", "Y", "z"), (3, "X", "y", "z"), (4, "x", "y", None)], old.schema)
    plan = media.plan_stages(new, media.wanted_stages(old, config), config).orderBy("item_id", "stage_no").collect()
    assert [[r.cached for r in plan if r.item_id == i] for i in (1, 2, 3, 4)] == [[True] * 3, [True, False, False], [False] * 3, [False] * 3]


def test_similarity_modes(spark):
    df = spark.createDataFrame([("ab cd", "abcd!"), ("", "x"), ("kitten", "sitting"), ("!!", "!!")], "a string, b string")
    exact = [r.s for r in df.select(similarity.similarity(F.col("a"), F.col("b"), "exact").alias("s")).collect()]
    native = [r.s for r in df.select(similarity.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert exact == [1.0, 0.0, similarity.ratio("kitten", "sitting"), 0.0]
    assert native[:2] == [1.0, 0.0] and abs(native[2] - (1 - 3 / 7)) < 1e-9 and native[3] == 0.0


def test_boxes(spark):
    one = lambda c: spark.range(1).select(c.alias("b")).first().b
    assert one(regions.normalized(regions.box(-1.0, 0.99, 5.0, 0.5), pad=False)).asDict() == {"x": 0.0, "y": 0.98, "w": 1.0, "h": 0.020000000000000018}
    assert one(regions.overlap(regions.box(0.0, 0.0, 0.4, 0.4), regions.box(0.2, 0.2, 0.1, 0.1))) == pytest.approx(1.0)
    details = one(regions.detail_boxes(F.array(regions.box(0.5, 0.5, 0.1, 0.1), regions.box(0.1, 0.2, 0.001, 0.3), regions.box(0.1, 0.1, 0.2, 0.1))))
    assert [(round(d.x, 3), round(d.y, 3)) for d in details] == [(0.096, 0.096), (0.496, 0.496)]


def test_written_tables_stay_readable(spark):
    assert written(spark.range(5), "check").count() == 5


def plain_groups(shapes, threshold, strict, least):
    """Every box tested against every box of every group, in order."""
    groups, out = [], []
    for b in shapes:
        meets = lambda m: boxes._shared(b, m, least) > threshold if strict else boxes._shared(b, m, least) >= threshold  # noqa: B023,E731
        hit = next((n for n, members in enumerate(groups) if any(meets(m) for m in members)), len(groups))
        if hit == len(groups):
            groups.append([])
        groups[hit].append(b)
        out.append(hit)
    return out


@pytest.mark.parametrize(("threshold", "strict", "least"), [(0.28, False, 1e-9), (0.25, True, 1e-6), (0.9, False, 1e-9)])
def test_overlap_groups_equal_all_tests(spark, threshold, strict, least):
    """Boxes of all sizes, off the screen, equal, without area, in crowds."""
    rng = random.Random(int(threshold * 100))
    shapes = []
    for _ in range(700):
        size = 2.0 ** -rng.choice((0, 1, 3, 5, 9, 30))
        shapes.append((rng.choice((-1.5, 0.0, 0.25, rng.random())), rng.random() * size, rng.choice((size, size * rng.random())), size * rng.random()))
        if rng.random() < 0.2:
            shapes.append(rng.choice(shapes))
        if rng.random() < 0.05:
            shapes.append((0.3, 0.3, rng.choice((0.0, -0.2)), 0.5))
    rows = [("v", i, *b) for i, b in enumerate(shapes)]
    df = spark.createDataFrame(rows, "video_id string, item long, x double, y double, w double, h double").repartition(3)
    got = {r.item: r.grp for r in boxes.overlap_groups(df, ["video_id"], threshold, strict, least).collect()}
    assert [got[i] for i in range(len(rows))] == plain_groups(shapes, threshold, strict, least)


def test_overlap_groups_of_a_crowded_key():
    """Forty thousand boxes of one key in thousands of groups: each is tested against a few."""
    rng = random.Random(3)
    rows = [(i, rng.randrange(90) / 90 + rng.random() / 900, rng.randrange(90) / 90 + rng.random() / 900, 0.009, 0.009) for i in range(40_000)]
    tests = 0

    def counting(a, b, least, plain=boxes._shared):
        nonlocal tests
        tests += 1
        return plain(a, b, least)

    plain, boxes._shared = boxes._shared, counting
    try:
        got = list(boxes._first_group(0.28, False, 1e-9)((), iter(rows)))
    finally:
        boxes._shared = plain
    places = len({(int(x * 90), int(y * 90)) for _, x, y, _, _ in rows})
    assert len({g for _, g in got}) == places and tests < 40 * len(rows)


def clusters_one_by_one(texts, threshold):
    groups = []
    for i, value in enumerate(texts):
        near = [max(similarity.ratio(value, texts[j]) for j in g) for g in groups]
        best = max(range(len(near)), key=near.__getitem__, default=-1)
        if best >= 0 and near[best] >= threshold:
            groups[best].append(i)
        else:
            groups.append([i])
    return groups


def spellings(seed, n, letters, size):
    """Texts of a few families, each changed at random places, some of them long or empty."""
    rng, out = random.Random(seed), {"": None}
    while len(out) < n:
        base = random.Random(rng.randrange(max(2, n // 12))).choices(letters, k=rng.choice([size, size, size + 5]))
        for _ in range(rng.randrange(5)):
            base[rng.randrange(len(base))] = rng.choice(letters)
        if rng.random() < 0.3:
            del base[rng.randrange(len(base))]
        out["".join(base) * (12 if rng.random() < 0.02 else 1)] = None
    return list(out)


@pytest.mark.parametrize("threshold", [0.05, 0.5, 0.72, 0.95, 1.0])
@pytest.mark.parametrize("letters,size", [("ab", 6), ("abcdefghijklmnop", 14), ("欢迎光临直播间今天气很好啊", 5)])
@pytest.mark.parametrize("few", [0, 256])
def test_clusters_by_shared_pairs(monkeypatch, threshold, letters, size, few):
    monkeypatch.setattr(votes, "FEW", few)
    texts = spellings(len(letters), 150 if len(letters) > 2 else 60, letters, size)
    assert votes.clusters(texts, threshold, similarity.ratio_from, True) == clusters_one_by_one(texts, threshold)


@pytest.mark.parametrize("seed", range(4))
def test_spokesman_by_bounds(seed):
    texts = [x for x in spellings(seed, 80, "abcdefgh", 10) if x]
    rng = random.Random(seed)
    weights, sure, asked = [rng.choice([1, 1, 2, 9]) for _ in texts], [rng.random() for _ in texts], []
    total = sum(weights)
    peers = lambda i: asked.append(i) or sum(w * (1.0 if i == j else similarity.ratio(texts[i], texts[j])) for j, w in enumerate(weights))
    standing = lambda i, p: ((p - 1.0) / (total - 1) * 0.82 + sure[i] * 0.18, -i)
    want = max(range(len(texts)), key=lambda i: standing(i, peers(i)))
    asked.clear()
    assert votes.spokesman(texts, weights, standing, peers, True) == want and len(asked) < len(texts)


def test_many_distinct_texts_are_not_all_compared():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=18)) for _ in range(6000)]
    near = [x[:7] + "#" + x[8:] for x in texts[:1000]]
    calls = []
    close = lambda a, b, floor: calls.append(1) or similarity.ratio_from(a, b, floor)
    groups = votes.clusters(texts + near, 0.72, close, True)
    assert all([i, 6000 + i] in groups for i in range(1000)) and len(calls) < 7000 * 7000 / 2 / 50


def test_exact_similarity_query(spark):
    from clipmetrics.plans import captions as plans

    sf = "/root/testdata/sf0.001"
    got = {r.p_partkey: r.similarity for r in plans.text_similarity_exact(spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/part.parquet").collect():
        a, b = (similarity.comparable(x.lower()) for x in (p.p_name, p.p_type + " " + p.p_brand))
        assert got[p.p_partkey] == pytest.approx(similarity.ratio(a, b), abs=1e-9)


def test_consensus_of_texts_query(spark):
    from clipmetrics.plans import captions as plans

    sf = "/root/testdata/sf0.001"
    rows = {}
    for p in spark.read.parquet(f"{sf}/part.parquet").orderBy("p_partkey").collect():
        rows.setdefault(p.p_size, []).append((" ".join((p.p_name, p.p_type, p.p_brand)), p.p_partkey % 499 / 499.0, p.p_partkey))
    got = plans.consensus_of_texts(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.confidence, r.winner_count, r.observation_count, r.representative_ord) == vote_one_by_one(rows[r.size], 0.72)


def test_alike_texts_are_compared_by_bounds():
    """Texts of a few words each, nearly all alike: the closest one is found without asking all that are close enough."""
    rng, words = random.Random(7), ["blue", "small", "old", "ring", "bolt", "plate", "LARGE", "ECONOMY", "Brand"]
    texts = list(dict.fromkeys("".join(rng.choices(words, k=4)) + str(rng.randrange(30)) for _ in range(600)))
    calls = []
    close = lambda a, b, floor: calls.append(1) or similarity.ratio_from(a, b, floor)
    assert votes.clusters(texts, 0.72, close, True) == clusters_one_by_one(texts, 0.72)
    assert len(calls) < 12 * len(texts)


def test_consensus_of_gathered_lists(spark):
    """The vote over gathered lists is that of the aggregate, and the query over many small days uses it."""
    from clipmetrics.plans import captions as plans

    rng = random.Random(11)
    rows = [(i % 37, rng.choice([None, "", " ​", "sale now", "sale now!", "sales now", "other"]), rng.choice([None, -1.0, float("nan"), 0.3, 0.9]), i) for i in range(300)]
    spark.createDataFrame([*rows, (99, None, 0.5, 1)], "k int, text string, confidence double, ord long").createOrReplaceTempView("gathered")
    captions.register_consensus(spark)
    got = spark.sql("""select k, consensus_text(text, confidence, ord) as a from gathered group by k""").collect()
    of = spark.sql("""select k, consensus_text_of(collect_list(struct(text, confidence, ord))) as a from gathered group by k""").collect()
    assert sorted(got) == sorted(of) and len(of) == 38
    plan = plans.consensus_sql(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "AggregatePython" not in plan
