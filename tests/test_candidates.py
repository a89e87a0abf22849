from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from clipmetrics import schemas
from clipmetrics.functions import text
from clipmetrics.operators import candidates, grams, jobs, ranking, search
from clipmetrics.params import CaptionParams, SearchFilters, expansion_limit, search_limit



def now():
    return F.expr("timestamp'2026-07-01 12:00:00'")


def videos(spark, *rows):
    """Rows as dicts over the canonical columns."""
    names = ["seq", *schemas.VIDEO_COLUMNS]
    full = [tuple({"seq": i, **row}.get(n) for n in names) for i, row in enumerate(rows)]
    kinds = dict(f.split(" ") for f in schemas.VIDEOS.split(", "))
    return spark.createDataFrame(full, ", ".join(f"{n} {kinds[n]}" for n in names))


def test_merge_takes_largest_counters_and_first_texts(spark):
    df = videos(
        spark, {"video_id": "1", "platform": "douyin", "title": "", "likes": 5000, "views": 10},
        {"video_id": " 1 ", "platform": " DOUYIN", "title": "late title", "likes": 7000, "duration_sec": 30},
        {"video_id": "2", "platform": "douyin", "title": "other", "likes": 1},
    )
    rows = candidates.merge_candidates(df).orderBy("seq").collect()
    assert [(r.seq, r.video_id, r.title, r.likes, r.views, r.duration_sec) for r in rows] == [
        (0, "1", "late title", 7000, 10, 30), (2, "2", "other", 1, None, None)]


def test_merge_blank_identity_collapses_unless_switched_off(spark):
    rows = [{"video_id": " ", "platform": "p", "title": "a"}, {"platform": "P ", "title": "b"}, {"platform": "p", "url": "u", "title": "c"}]
    df = videos(spark, *rows)
    assert candidates.merge_candidates(df).count() == 2
    assert candidates.merge_candidates(df, collapse_blank=False).count() == 3


def test_merge_is_idempotent_and_ignores_partitioning(spark):
    rng = random.Random(3)
    df = videos(spark, *[{"video_id": str(rng.randrange(20)), "platform": "p", "title": rng.choice(["", f"t{i}", None]), "likes": rng.randrange(100)} for i in range(300)])
    once = candidates.merge_candidates(df)
    again = candidates.merge_candidates(once.select(df.columns))
    other = candidates.merge_candidates(df.repartition(7, F.rand(1)))
    key = lambda d: sorted(map(str, d.select(df.columns).collect()))
    assert key(once) == key(again) == key(other)


def test_filter_treats_unknown_values_by_field(spark):
    old = datetime.datetime(2026, 1, 1)
    df = videos(
        spark, {"video_id": "1", "likes": 20, "duration_sec": 30}, {"video_id": "2", "likes": 5, "duration_sec": 30},
        {"video_id": "3", "likes": 20, "duration_sec": 90}, {"video_id": "4", "likes": None}, {"video_id": "5", "likes": 20, "views": 0},
        {"video_id": "6", "likes": 20, "views": 3}, {"video_id": "7", "likes": 20, "published_at": old},
        {"video_id": "8", "likes": 20, "published_at": datetime.datetime(2027, 1, 1)},
    )
    kept = candidates.filter_candidates(df, SearchFilters(10, 10, 60, 30), now())
    assert sorted(r.video_id for r in kept.collect()) == ["1", "5", "8"]
    assert candidates.filter_candidates(df, SearchFilters(), now()).count() == 8


def test_scores_and_order(spark):
    df = videos(
        spark, {"video_id": "a", "platform": "douyin", "title": "Kitchen tools review", "likes": 900, "search_source": "kitchen tools", "duration_sec": 40, "published_at": datetime.datetime(2026, 7, 1, 11, 30)},
        {"video_id": "b", "platform": "acfun", "title": "other", "search_source": "kitchen tools", "duration_sec": 500},
        {"video_id": "c", "platform": "weibo", "title": "x", "search_source": "厨房好物", "published_at": datetime.datetime(2026, 8, 1)},
    )
    rows = {r.video_id: r for r in ranking.score(df, F.lit("kitchen tools"), now()).collect()}
    assert (rows["a"].engagement, rows["a"].relevance) == (100.0, 100.0)
    assert rows["b"].recency == 35.0 and rows["c"].recency == 100.0
    assert rows["c"].relevance == 75.0
    assert rows["a"].affiliate == round(100 * (0.55 * 0.95 + 0.30 * 0.25 + 0.15), 1)
    assert rows["b"].affiliate == round(100 * (0.55 * 0.46 + 0.30 * 0.35 + 0.15 * 0.40), 1)
    assert [r.video_id for r in ranking.top(ranking.score(df, F.lit("kitchen tools"), now())).collect()][0] == "a"
    assert {r.relevance for r in ranking.score(df, F.lit("x"), now()).collect()} == {50.0}


def test_no_engagement_at_all_scores_zero(spark):
    rows = ranking.score(videos(spark, {"video_id": "a", "platform": "p"}), F.lit("word"), now()).collect()
    assert rows[0].engagement == 0.0 and rows[0].trend == round(100 * 0.35 * 0.35, 1)


@pytest.mark.parametrize(("name", "want"), [(" @Mimi_Official ", "mimi official"), ("Mimi-Official", "mimi official"), ("干嘛猫", "干嘛猫"), ("  干嘛猫  ", "干嘛猫"), ("@ a · b", "a b"), ("", "")])
def test_channel_name(spark, name, want):
    assert spark.range(1).select(text.channel_name(F.lit(name)).alias("n")).first().n == want


def test_channel_filter_is_exact(spark):
    df = videos(spark, *[{"video_id": str(i), "author": a} for i, a in enumerate(["Mimi Official", "Mimi Studio", "", None])])
    assert [r.video_id for r in candidates.of_channel(df, "@Mimi_Official").collect()] == ["0"]
    assert candidates.of_channel(df, " @ ").count() == 0
    many = spark.createDataFrame([("mimi-studio",), (" ",), ("MIMI studio",)], "channel string")
    assert [r.video_id for r in candidates.of_channels(df, many).collect()] == ["1"]


def test_expansion(spark):
    df = spark.createDataFrame([(1, "đồ bếp tiện ích"), (2, "hoàn toàn lạ"), (3, "  "), (4, "Kitchen camping pet")], "id int, topic string")
    rows = search.expand_topics(df, "topic", 8).orderBy("id", "phrase_no").collect()
    by_id = {i: [r.phrase for r in rows if r.id == i] for i in (1, 2, 3, 4)}
    assert by_id[1][0] == "đồ bếp tiện ích" and "厨房好物" in by_id[1] and len(by_id[1]) == 8
    assert by_id[2] == ["hoàn toàn lạ"] and by_id[3] == []
    assert by_id[4][1:] == sorted(by_id[4][1:]) and len(by_id[4]) == 8
    assert len(search.expand_topics(df.where("id = 4"), "topic", 3).collect()) == 3


def test_expansion_drops_case_variants(spark):
    groups = [(["a"], ["Zed", "zed ", "A topic", "b"])]
    row = search.with_phrases(spark.createDataFrame([("a topic",)], "topic string"), "topic", 8, groups).first()
    assert row.phrases == ["a topic", "Zed", "b"]


def test_limits():
    assert [search_limit(v) for v in (0, 5, 500)] == [30, 5, 100]
    assert [expansion_limit(v) for v in (0, 3, 50)] == [4, 3, 8]
    with pytest.raises(ValueError):
        SearchFilters(min_likes=-1)
    with pytest.raises(ValueError):
        CaptionParams(max_gap=0.01)


@pytest.mark.parametrize("automaton_bytes", [1 << 20, 0])
def test_phrase_search_equals_brute_force(spark, automaton_bytes):
    rng = random.Random(5)
    alphabet = ["ab", "ba", "好物", "c", "-", " ", " ", "Ä"]
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for i in range(120)]
    phrases = [(f"p{i}", "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 6)))) for i in range(40)] + [("q", "物"), ("blank", "  "), ("r", "ab ba ab")]
    found = search.phrase_matches(spark.createDataFrame(texts, "id int, text string"), ["id"], "text", spark.createDataFrame(phrases, "phrase_id string, phrase string"), automaton_bytes)
    got = sorted((r.id, r.phrase_id) for r in found.collect())
    want = sorted((i, p) for i, t in texts for p, s in phrases if s.strip() and s.strip().lower() in t.lower())
    assert got == want


def test_phrase_search_of_very_many_words(spark):
    """Ten thousand one-word phrases, one of them in every text, in one pass over the texts."""
    phrases = spark.range(10_000).selectExpr("id as phrase_id", "concat('w', id, 'x') as phrase")
    texts = spark.range(3000).selectExpr("id", "concat('a w77x b w', id, 'x and ', repeat('filler ', 50)) as text")
    found = search.phrase_matches(texts, ["id"], "text", phrases)
    got = {(r.id, r.phrase_id) for r in found.collect()}
    assert got == {(i, p) for i in range(3000) for p in (77, i)}


def test_phrase_search_of_a_million_phrases(spark):
    """Needles far beyond what one automaton may hold; one of them in every text, one in a single very long text."""
    phrases = spark.range(1_000_000).selectExpr("id as phrase_id", "concat(' w', id, 'x ') as phrase")
    texts = spark.range(500).selectExpr("id", "concat('a w77x b w', id * 1999, 'X and ', repeat('filler ', 20)) as text")
    long_text = spark.createDataFrame([(-1, "äb" * 600_000 + "w123456x" + "c" * 600_000), (-2, None), (-3, "")], "id long, text string")
    found = search.phrase_matches(texts.unionByName(long_text), ["id"], "text", phrases)
    got = sorted((r.id, r.phrase_id) for r in found.collect())
    assert got == sorted({(i, p) for i in range(500) for p in (77, i * 1999)} | {(-1, 123456)})


def test_grams_of_very_many_texts_are_dealt_to_several_keys(spark):
    """Every text holds the needles' only gram; rows that repeat and rows without text keep their meaning."""
    rows = [(i % 90, f"t{i % 90} ab", "x") for i in range(120)] + [(500, None, "x")]
    df = spark.createDataFrame(rows, "id int, text string, needle string").withColumn("key", F.xxhash64("id", "text"))
    needles = spark.createDataFrame([("ab",), ("t7 ab",), ("zz",)], "needle string")
    pairs = grams.candidates(df.where("text is not null").select("key", "text"), needles, per_key=7).collect()
    of = {r.key: r.text for r in df.collect()}
    assert len(pairs) == len(set(pairs))
    assert {(of[r.key], r.needle) for r in pairs} >= {(t, n) for _, t, _ in rows if t for n in ("ab", "t7 ab") if n in t}
    found = search.phrase_matches(df.drop("key"), ["id"], "text", needles.selectExpr("needle as phrase_id", "needle as phrase"), 0)
    assert sorted(map(tuple, found.select("id", "phrase_id").collect())) == sorted(
        (i, n) for i, t, _ in rows if t for n in ("ab", "t7 ab") if n in t)


def test_larger_limits_give_more_rows(spark):
    df = videos(spark, *[{"video_id": str(i), "likes": i} for i in range(600)]).withColumn("overall", F.col("likes").cast("double"))
    assert ranking.top(df, "overall", 500).count() == 500 and ranking.top_per_query(df, ["platform"], "overall", 500).count() == 500
    topics = spark.createDataFrame([("Kitchen camping pet",)], "topic string")
    assert [search.expand_topics(topics, "topic", n).count() for n in (3, 8)] == [3, 8] and search.expand_topics(topics, "topic").count() > 8


def test_error_summary(spark):
    runs = [(1, "a", "k1", "boom", 0), (2, "a", "k1", "boom", 0), (3, "a", "k2", "boom", 0), (4, "a", None, "down", 0), (5, "b", "k", "x", 0), (6, "b", "k", None, 2), (7, "c", "k", None, 0)]
    out = search.error_summary(spark.createDataFrame(runs, "seq int, source string, keyword string, error string, n_results int")).collect()
    assert [(r.source, r.summary) for r in out] == [("a", "k1: boom | k2: boom | +1 lỗi tương tự")]


def test_fan_out(spark):
    req = spark.createDataFrame([(1, ["a", "b", "c", "d"], [" Weibo", "weibo", "bilibili", "zzz", ""], 100), (2, ["a"], [], 0)], "id int, phrases array<string>, sources array<string>, limit int")
    rows = search.fan_out(req).collect()
    one = [(r.source, r.phrase, r.error) for r in rows if r.id == 1]
    assert [p for s, p, _ in one if s == "weibo"] == ["a", "b", "c"] and len([1 for s, *_ in one if s == "bilibili"]) == 4
    assert ("zzz", None, "unknown source") in one and len(one) == 8
    modes = spark.createDataFrame([(v, ["a"], ["weibo"], v, m) for m in ("keyword", "Creator ") for v in (5, 20, 90)] + [(100, list("abcdef"), ["weibo"], 100, "")], "id int, phrases array<string>, sources array<string>, limit int, mode string")
    assert [r.query_limit for r in search.fan_out(modes).where("phrase_no = 0").collect()] == [10, 20, 90, 30, 80, 100, 17]
    assert {r.query_limit for r in rows if r.id == 1} == {25} and len([r for r in rows if r.id == 2]) == 11


def test_fill_keeps_first_tier_then_fills(spark):
    one = videos(spark, {"video_id": "1", "platform": "d"}, {"video_id": "2", "platform": "d"})
    two = videos(spark, {"video_id": "2", "platform": "d"}, {"video_id": "3", "platform": "d"}, {"video_id": "4", "platform": "d"}, {"platform": "d"}, {"url": "u", "platform": "d"})
    assert [r.video_id for r in candidates.by_id_or_url([one, two], [], 4).collect()] == ["1", "2", "3", "4"]
    assert candidates.by_id_or_url([one, two], ["platform"], 50).count() == 5


def test_preview_merge_overrides_known_values_only(spark):
    base = videos(spark, {"video_id": "1", "title": "old", "likes": 4, "views": 9}, {"video_id": "2", "title": "keep"})
    fresh = videos(spark, {"seq": 0, "video_id": "", "title": "new", "likes": 0, "views": 11})
    rows = candidates.merge_preview(base, fresh).orderBy("seq").collect()
    assert (rows[0].video_id, rows[0].title, rows[0].likes, rows[0].views, rows[1].title) == ("1", "new", 4, 11, "keep")


def test_job_transitions(spark):
    states = ["queued", "downloading", "localizing", "rendering", "aspect_rendering", "done", "failed", "localization_failed"]
    df = spark.createDataFrame([(s, s, i - 1, "old") for i, s in enumerate(states)], "job_id string, status string, attempts int, error string")
    resumed = {r.job_id: r for r in jobs.resume(df).collect()}
    assert [resumed[s].status for s in states] == ["queued"] * 4 + ["done", "done", "failed", "localization_failed"]
    assert resumed["aspect_rendering"].error.startswith("aspect render was interrupted") and resumed["queued"].attempts == 1
    retried = {r.job_id: r for r in jobs.retry(df).collect()}
    assert [retried[s].rejected for s in states] == ["job is already running"] * 5 + ["job is already complete", None, None]
    assert (retried["failed"].status, retried["failed"].error, retried["failed"].attempts) == ("queued", None, 6)


def test_history_prefers_id_then_address(spark):
    cands = videos(spark, {"video_id": "1", "platform": "p", "url": "u1"}, {"video_id": "9", "platform": "p", "url": "u2"}, {"video_id": "", "platform": "p", "url": ""}, {"video_id": "1", "platform": "q", "url": "zz"})
    hist = spark.createDataFrame([("p", "1", "x", "done", 1), ("p", "1", "x", "localization_failed", 2), ("p", "", "u2", "rendering", 3), ("p", "", "", "failed", 4)], "platform string, video_id string, url string, status string, seq long")
    got = {r.seq: r.history for r in jobs.with_history(cands, hist).collect()}
    assert got == {0: "done_processing_failed", 1: "in_progress", 2: "not_downloaded", 3: "not_downloaded"}


def test_unseen_looks_at_addresses_spellings_and_failed_processing(spark):
    cands = videos(spark, *[{"video_id": v, "platform": "weibo", "url": u} for v, u in (("1", "a"), ("2", "b"), ("3", "c"), ("4", "d"), ("5", "e"))])
    hist = spark.createDataFrame(
        [(" Weibo", "1", "", "done", 1), ("weibo", "", "b", "done", 2), ("weibo", "3", "", "localization_failed", 3), ("weibo", "4", "", "failed", 4)],
        "platform string, video_id string, url string, status string, seq long")
    assert sorted(r.video_id for r in jobs.unseen(cands, hist).collect()) == ["4", "5"]


def test_restart_normalises_settings_and_sets_the_time(spark):
    df = spark.createDataFrame([("a", "queued", 0, None, " DUB", "4:3", 1), ("b", "done", 1, None, None, "9:16 ", 2), ("c", "failed", 1, "x", "dub", "", 3)],
                               "job_id string, status string, attempts int, error string, mode string, aspect string, updated_at long")
    got = {r.job_id: (r.mode, r.aspect, r.updated_at) for r in jobs.resume(df, F.lit(99)).collect()}
    assert got == {"a": ("dub", "original", 99), "b": ("dub", "9:16", 2), "c": ("dub", "original", 3)}
    assert {r.job_id: r.updated_at for r in jobs.retry(df, F.lit(99)).collect()} == {"a": 1, "b": 2, "c": 99}


def test_settings(spark):
    df = spark.createDataFrame([("", "", ""), (" DUB ", "9:16", "ocr_capsule"), ("karaoke", "1:1", "box"), ("dub", "4:3", "neon"), ("dub", "original", "neon")], "mode string, aspect string, style string")
    rows = [(r.mode, r.aspect, r.style, r.invalid) for r in jobs.validate_settings(df).collect()]
    assert rows == [("dub", "original", "clean", None), ("dub", "9:16", "capsule", None), ("dub", "1:1", "box", "mode"), ("dub", "original", None, "aspect"), ("dub", "original", None, "style")]
    kinds = spark.createDataFrame([("channel",), ("Creator ",), ("",)], "k string")
    assert [r.m for r in kinds.select(jobs.search_mode(F.col("k")).alias("m")).collect()] == ["channel", "channel", "keyword"]
