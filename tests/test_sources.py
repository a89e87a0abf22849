from __future__ import annotations

import json
import tempfile

from pyspark.sql import functions as F

from clipmetrics import rules
from clipmetrics.functions import text, urls
from clipmetrics.operators import candidates
from clipmetrics.sources import jobs as store
from clipmetrics.sources import landed, pages, registry, subtitles


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


ACCEPTED = {
    "xiaohongshu": "https://www.xiaohongshu.com/explore/64d0c2b5e1f3a79800452b1d",
    "weibo": "https://weibo.com/tv/show/1042:4908877665",
    "xigua": "https://www.ixigua.com/6900112233445566778/",
    "haokan": "https://haokan.baidu.com/v?vid=4455667788990011223",
    "toutiao": "https://www.toutiao.com/video/6811223344556677889/",
    "acfun": "https://www.acfun.cn/v/ac40213377",
    "meipai": "https://www.meipai.com/media/6655443322",
    "weishi": "https://weishi.qq.com/t/Zq9wXy7",
}


def test_one_accepted_address_per_platform(spark):
    df = spark.createDataFrame(list(ACCEPTED.items()), "platform string, url string")
    rows = df.select("platform", urls.platform_url(F.col("platform"), F.col("url")).alias("ok"), urls.platform_url(F.col("platform"), F.lit("https://example.com/video/123456789")).alias("bad")).collect()
    assert all(r.ok == ACCEPTED[r.platform] and r.bad is None for r in rows)


def test_canonical_address(spark):
    cases = {
        " HTTPS://Host.com/p?b=2&utm_x=1&a=&SPM=2&a=%C3%BC+x#f ": "https://Host.com/p?a=&a=%C3%BC+x&b=2",
        "http://h.com/a~b*?q=~*": "http://h.com/a~b*?q=~%2A", "ftp://h.com/a": None, "nonsense": None,
        "https://h.com/caf%C3%A9/é?x": "https://h.com/caf%C3%A9/%C3%A9?x=", "https://h.com?x=1;y=2&z=3": "https://h.com?z=3",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.c for r in df.select("u", urls.canonical_url(F.col("u")).alias("c")).collect()} == cases


def test_entities_of_every_kind(spark):
    import html
    import random

    rng = random.Random(3)
    pieces = ["&amp;", "&lt;", "&#39;", "&nbsp;", "&copy;", "&copy", "&#x41;", "&#66", "&eacute;", "&notit;", "&", ";", "amp;", "#39;", "x", " ", "lt"]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(400)] + [None, "plain"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert all(r.u == (None if r.v is None else html.unescape(r.v)) for r in df.select("v", text.unescape(F.col("v")).alias("u")).collect())


def test_redirects(spark):
    assert value(spark, urls.unwrap_redirect(F.lit("https://duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.kuaishou.com%2Fshort-video%2Fabc"))) == "https://www.kuaishou.com/short-video/abc"
    assert value(spark, urls.unwrap_redirect(F.lit("//duckduckgo.com/y.js?x=1"))) == ""
    assert value(spark, urls.unwrap_redirect(F.lit("//h.com/a"))) == "https://h.com/a"


def test_host_lists(spark):
    ok = lambda p, u: value(spark, urls.preview_host_allowed(F.lit(p), F.lit(u)))
    assert ok("Bilibili", "https://www.b23.tv/x") and ok("weibo", "https://m.weibo.cn:443/1")
    assert not ok("bilibili", "https://evilb23.tv/x") and not ok("nowhere", "https://b23.tv/x")


FEED = ["<item><title>周末钓鱼日记 - 抖音</title><link>https://www.douyin.com/video/7301446688002244557</link><description>d</description></item>",
        "<item><title>duplicate</title><link>https://www.douyin.com/video/7301446688002244557?x=1</link></item>",
        "<item><title>foreign</title><link>https://example.com/watch/1</link></item>"]


def test_feed_candidates(spark):
    df = spark.createDataFrame(list(enumerate(FEED)), "seq long, xml string")
    rows = landed.feed_candidates(landed.feed_items(df, "xml", ["seq"]), F.lit("kw")).collect()
    assert [(r.video_id, r.title, r.url, r.search_source) for r in rows] == [("7301446688002244557", "周末钓鱼日记", "https://www.douyin.com/video/7301446688002244557", "kw")]
    folder = tempfile.mkdtemp(prefix="run-feed-")
    with open(f"{folder}/a.xml", "w", encoding="utf-8") as f:
        f.write("<rss><channel>" + "".join(FEED) + "</channel></rss>")
    assert landed.feed_candidates(landed.read_feed_items(spark, folder), F.lit("kw")).count() == 1


def test_json_lines(spark):
    folder = tempfile.mkdtemp(prefix="run-lines-")
    lines = [json.dumps({"bvid": "BV1", "title": "t", "pubdate": 0, "like_count": 3}), "{broken", json.dumps({"bvid": " "}), json.dumps({"bvid": "BV2", "url": "https://x/2", "pubdate": 1701234567})]
    with open(f"{folder}/a.jsonl", "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    rows = landed.read_json_lines(spark, folder, "kw").orderBy("seq").collect()
    assert [(r.video_id, r.url, r.likes, r.published_at is None) for r in rows] == [("BV1", "https://www.bilibili.com/video/BV1", 3, True), ("BV2", "https://x/2", None, False)]


def test_file_order_does_not_depend_on_packing(spark):
    """Small splits of several files: seq follows path, then line, whichever task reads what."""
    folder = tempfile.mkdtemp(prefix="run-order-")
    want = []
    for name, n in (("c", 300), ("a", 5), ("b", 4000)):
        with open(f"{folder}/{name}.jsonl", "w", encoding="utf-8") as f:
            f.writelines(json.dumps({"bvid": f"{name}{i}"}) + "\n" for i in range(n))
    for name, n in (("a", 5), ("b", 4000), ("c", 300)):
        want += [f"{name}{i}" for i in range(n)]
    for size in ("128m", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = landed.read_json_lines(spark, folder, "kw").select("seq", "video_id").collect()
        assert [r.video_id for r in sorted(rows)] == want and sorted(r.seq for r in rows) == list(range(len(want)))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


ITEM = {"aweme_id": "7301446688002244557", "desc": "钓竿", "create_time": 1701234567, "author": {"nickname": "lab"},
        "statistics": {"play_count": 120, "digg_count": 9, "comment_count": 4, "share_count": 1}, "video": {"duration": 33000, "cover": {"url_list": ["https://i/1.jpg", "x"]}}}


def test_search_json(spark):
    page = {"status_code": 0, "data": [{"type": 1, "aweme_info": ITEM}, {"type": 1, "aweme_info": {"aweme_id": "2"}}, {"type": 9}]}
    df = spark.createDataFrame([(1, json.dumps(page))], "page int, body string")
    rows = landed.search_page_candidates(df, "body", ["page"], F.lit("kw")).orderBy("pos").collect()
    assert len(rows) == 2
    assert (rows[0].likes, rows[0].duration_sec, rows[0].thumbnail, rows[0].author) == (9, 33, "https://i/1.jpg", "lab")
    assert (rows[1].title, rows[1].views) == ("Douyin search: kw", None)


def test_deep_json_finds_items_at_any_depth(spark):
    deep = {"a": [{"b": {"aweme": {"aweme_id": "11"}}}, {"c": [{"d": {"aweme_id": "12", "more": [{"aweme_id": "13"}]}}]}]}
    far = {"aweme_id": "20"}
    for _ in range(60):
        far = {"n": [far]}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, json.dumps([{"aweme_info": {"aweme_id": "12"}}, far])), (3, "no json")], "page int, body string")
    rows = landed.deep_candidates(df, "body", "page", [], F.lit("kw")).collect()
    assert sorted((r.video_id, r.page) for r in rows) == [("11", 1), ("12", 1), ("13", 1), ("20", 2)]


def test_status_triage(spark):
    df = spark.createDataFrame([(1, '{"status_code":2483}'), (2, '{"status_code":"7","status_msg":" bad "}'), (3, "{}"), (4, "<")], "id int, body string")
    rows = landed.search_status(df, "body", ["id"]).orderBy("id").collect()
    assert [(r.id, r.state, r.error) for r in rows] == [(1, "login_required", None), (2, "error", "status 7: bad"), (3, "ok", None)]


def test_links(spark):
    df = spark.createDataFrame(list(enumerate(["https://www.douyin.com/video/7301446688002244557", "/video/7301446688002244557?a", "https://www.douyin.com/video/7301446688002244558", "/user/1"])), "seq long, link string")
    assert [r.video_id for r in landed.link_candidates(df, F.lit("kw")).orderBy("seq").collect()] == ["7301446688002244557", "7301446688002244558"]


def test_short_video_links(spark):
    html = """<a href="/short-video/kx7qp2ma">手工面条教程</a> <a href="https://www.kuaishou.com/short-video/m2vd91tz?from=list">修车 &amp; <b>补胎</b></a>
    <script>{"url":"https:\\/\\/www.kuaishou.com\\/short-video\\/r5tt08wc"}</script>"""
    df = spark.createDataFrame([(1, html)], "page int, html string")
    rows = pages.video_links(df, ["page"], F.lit("面")).orderBy("pass", "pos").collect()
    assert [(r.video_id, r.title) for r in rows] == [("kx7qp2ma", "手工面条教程"), ("m2vd91tz", "修车 & 补胎"), ("r5tt08wc", "Kuaishou search: 面")]
    assert value(spark, urls.rebuilt_url(F.lit("https://www.kuaishou.com/short-video/kx7qp2ma?utm_source=x"), rules.KUAISHOU_URL, rules.KUAISHOU_ID)) == "https://www.kuaishou.com/short-video/kx7qp2ma"


def test_hydrated_page(spark):
    html = r"""<a href="/video/7301446688002244557"><span>雨天露营记录</span></a><script>push([1,"{\"aweme_id\":\"7301446688002244557\",\"statistics\":{\"play_count\":54321,\"digg_count\":876},\"create_time\":1701234567,\"video\":{\"duration\":33000}}"]);
    push([1,"{\"aweme_id\":\"7301446688002244558\"}"]);</script>"""
    rows = pages.video_ids(spark.createDataFrame([(1, html)], "page int, html string"), ["page"], F.lit("kw")).orderBy("pass", "pos").collect()
    assert [(r.video_id, r.title) for r in rows] == [("7301446688002244557", "雨天露营记录"), ("7301446688002244558", "Douyin search: kw")]
    assert (rows[0].views, rows[0].likes, rows[0].duration_sec) == (54321, 876, 33)


def test_nearby_text(spark):
    doc = '{"aweme_id":"7301446688002244557","desc":"a \\"b\\" &amp; c","nickname":"lab","play_count":5,"duration":900}'
    row = pages.nearby_metadata(spark.createDataFrame([(doc, "7301446688002244557")], "doc string, id string"), "doc", "id").first()
    assert (row.near_title, row.near_author, row.views, row.likes, row.duration_sec) == ('a "b" & c', "lab", 5, None, 900)


def test_media_candidates_order(spark):
    addr = lambda *u, **k: {"url_list": list(u), **k}
    item = {"bit_rate": [{"bit_rate": 100, "play_addr": addr("https://v/low.mp4")}, {"bit_rate": 900, "play_addr": addr("https://v/high.mp4", "https://v/low.mp4")}],
            "play_addr": addr("http://v/playwm/base", "ftp://v/x", uri=" id/1 ")}
    rows = pages.media_candidates(spark.createDataFrame([(1, json.dumps(item))], "id int, body string"), "body", ["id"]).orderBy("pos").collect()
    assert [r.url for r in rows[:4]] == ["https://v/high.mp4", "https://v/low.mp4", "https://v/play/base", "https://aweme.snssdk.com/aweme/v1/play/?video_id=id%2F1&ratio=1080p&line=0"]
    assert len(rows) == 7
    empty = spark.createDataFrame([(1, '{"item_list":[],"filter_list":[{"detail_msg":"gone"}]}')], "id int, body string")
    assert pages.unavailable_reason(empty, "body", ["id"]).first().reason == "gone"


def test_embedded_state(spark):
    docs = ['<script>window.INIT_STATE = {"x":{"photoUrl":"https://v/1.mp4"}};</script>', '<script>window.__APOLLO_STATE__={"y":[{"mainMvUrls":[{"url":"https://v/2.mp4"}]}]}</script>',
            r'''{bad, "photoUrl":"https:\/\/v\/3.mp4"}''', "nothing"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, html string")
    assert [r.media_url for r in pages.embedded_media_url(df, ["id"]).orderBy("id").collect()] == ["https://v/1.mp4", "https://v/2.mp4", "https://v/3.mp4", None]


def test_titles_and_entities(spark):
    assert value(spark, text.strip_site_suffixes(F.lit(" 标题 - 抖音 "))) == "标题"
    assert value(spark, text.strip_site_suffixes(F.lit("a_抖音 | 抖音"))) == "a_抖音"
    assert value(spark, text.clean_index_text(F.lit("&lt;b&gt;x&eacute;<i>y</i>  z"))) == "xé y z"
    assert value(spark, text.clean_page_text(F.lit("&lt;b&gt;x<i>y</i>"))) == "<b>x y"
    assert value(spark, text.is_generic_title(F.lit("Please LOGIN"))) and not value(spark, text.is_generic_title(F.lit("面")))
    assert value(spark, text.title_from_stem(F.lit("my_clip [BV1xx]"))) == "my clip"
    assert value(spark, text.tokens(F.lit("A bc, d好物-ef"))) == ["bc", "d好物", "ef"]


def test_srt_read_write_validate(spark):
    folder = tempfile.mkdtemp(prefix="run-srt-")
    cues = spark.createDataFrame([("v", 1, 0.0005, 1.5, "hello\nworld"), ("v", 2, 2.0, 3.0, " "), ("v", 3, 3.0, 4.25, "third")], "video_id string, ord long, start_s double, end_s double, text string")
    subtitles.write_srt(cues, f"{folder}/out")
    back = subtitles.read_srt(spark, f"{folder}/out/video_id=v").orderBy("start_s").collect()
    assert [(r.start_s, r.end_s, r.text) for r in back] == [(0.0, 1.5, "hello world"), (3.0, 4.25, "third")]
    assert [r.block.split("\n")[0] for r in subtitles.srt_blocks(cues).orderBy("block_no").collect()] == ["1", "3"]
    good = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nhi\r\n"
    df = spark.createDataFrame([(1, good), (2, "no timing"), (3, " \r\n")], "id int, content string")
    assert [(r.ok, r.reason) for r in subtitles.validate_srt(df, ["id"]).orderBy("id").collect()] == [(True, None), (False, "no timing line found"), (False, "subtitle cannot be empty")]
    assert value(spark, subtitles.normalized_srt(F.lit(good))) == "1\n00:00:01,000 --> 00:00:02,000\nhi\n"
    subtitles.register_srt_function(spark)
    assert [r.text for r in spark.sql("select * from srt_cues('1\n00:00:01,000 --> 00:00:02,000\nhi\n\n00:00:03.000 --> 00:00:02.000\nno')").collect()] == ["hi"]


def test_segment_metadata(spark):
    body = {"segments": [{"start": 1, "end": 2, "bbox": [0.1, 0.7, 0.5, 0.1], "bboxRegions": [[0.1, 0.7, 0.2, 0.1], [1]], "placement": " Bottom"}, {"start": 1, "end": 1, "bbox": [0, 0, 1, 1]}, {"start": 0, "end": 1}]}
    rows = subtitles.segments_from_json(spark.createDataFrame([(json.dumps(body),)], "c string"), "c", []).collect()
    assert len(rows) == 1 and rows[0].placement == "bottom" and len(rows[0].cleanup_regions) == 1


def test_job_table_evolution(spark):
    folder = tempfile.mkdtemp(prefix="run-jobs-")
    cols = "job_id string, status string, video_json string, outputs_json string, localization_json string, error string, created_ns long, updated_ns long"
    old = spark.createDataFrame([("a", "done", '{"id":"1","platform":"p"}', "{}", None, None, 10**18, 10**18)], cols)
    old.write.parquet(f"{folder}/t/part=1")
    new = old.selectExpr("'b' as job_id", "status", "video_json", "'{\"9:16\":\"x\"}' as outputs_json", "'{\"timings\":{\"ocr\":1.5},\"cacheHits\":[\"ocr\"]}' as localization_json", "error", "created_ns + 1000000000 as created_ns", "updated_ns", "7 as attempts", "2 as subtitle_revision", "'dub' as mode", "'9:16' as aspect")
    new.write.parquet(f"{folder}/t/part=2")
    rows = store.read_jobs(spark, f"{folder}/t").collect()
    assert [(r.job_id, r.attempts, r.aspect) for r in rows] == [("b", 7, "9:16"), ("a", 1, "original")]
    assert rows[0].localization.timings == {"ocr": 1.5} and rows[0].outputs == {"9:16": "x"} and rows[1].video.platform == "p"
    store.write_jobs(store.decode_jobs(new), f"{folder}/w")
    assert store.read_jobs(spark, f"{folder}/w").first().subtitle_revision == 2


def test_registry(spark):
    from test_candidates import videos

    corpus = videos(spark, {"video_id": "1", "title": "big kitchen tour", "platform": "landed"}, {"video_id": "2", "title": "cats", "platform": "landed"})
    registry.register(registry.LandedSource("landed", corpus))
    phrases = spark.createDataFrame([("p1", "Kitchen"), ("p2", "cats")], "phrase_id string, phrase string")
    found, errors = registry.search_all(["landed", " LANDED ", "nosuch"], phrases, 10)
    assert sorted((r.video_id, r.search_source) for r in found.collect()) == [("1", "Kitchen"), ("2", "cats")] and errors == {"nosuch": "unknown source"}
    assert candidates.merge_candidates(found).count() == 2


def test_ends_of_subtitles(spark):
    """The cheap look at the last bytes takes away exactly what a full trim does, with texts in and out of white space."""
    ends = ["", *text.WHITESPACE, "。", "é", "‰", "、", "x", "😀", " 　", "​", "﻿"]
    bodies = [a + m + b for m in ("", "x", " ", "欢") for a in ("", "﻿", " ", "　") for b in ends]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, v string")
    rows = df.select("v", subtitles._plain(F.col("v")).alias("p")).select("v", "p", subtitles._stripped(F.col("p")).alias("a"), text.strip("p").alias("b")).collect()
    for r in rows:
        bare = r.v[1:] if r.v.startswith("﻿") else r.v
        assert r.p == bare.replace("\r\n", "\n").replace("\r", "\n") and r.a == r.b


def test_media_urls_as_one_by_one(spark):
    odd = ["//a.example.com/x),;", "http://b.example.com/playwm/1", "HTTP://c.example.com", " http:\\/\\/d.example.com\\u002Fplay ", "https:///x", "https://e.example.com/?a=1&amp;b=2",
           "", None, ",", "https://f.example.com/a,\n,", "https://g.example.com/a\n", "ftp://h", "playwm", "http://http://i", "https://?x", "https:// y", "//", "&nbsp;//j.example.com]"]
    df = spark.createDataFrame([(odd,)], "u array<string>")
    r = df.select(urls.media_urls(F.col("u")).alias("a"), F.transform("u", lambda u: urls.media_url(u, full=False)).alias("b")).first()
    assert r.a == r.b and sum(x is not None for x in r.a) >= 6
