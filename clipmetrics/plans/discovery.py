"""Discovery queries: merging, filtering, ranking, expansion, search, landed formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics import rules
from clipmetrics.operators import candidates, ranking, search
from clipmetrics.params import SearchFilters, expansion_limit
from clipmetrics.plans.adapters import (HITS, NOW_SQL, document_hits, event_hits, hits, now, table)
from clipmetrics.schemas import VIDEO_COLUMNS
from clipmetrics.session import work_dir
from clipmetrics.sources import landed, registry

QUERY = "review onen the kitchen"
FLAT = ["seq", *VIDEO_COLUMNS]
SCORE_COLUMNS = ["seq", "video_id", "platform", "likes", "engagement", "recency", "relevance", "affiliate", "trend", "overall"]


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def merged_sql(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    text = ", ".join(f"arg_min({c}, seq) filter (where {c} <> '') as {c}" for c in ("title", "author", "url", "thumbnail", "download_url", "search_source"))
    return f"""select {lead}min(seq) as seq, first(video_id order by seq) as video_id, first(platform order by seq) as platform,
  first(media_type order by seq) as media_type, {text}, arg_min(duration_sec, seq) filter (where duration_sec <> 0) as duration_sec,
  max(views) as views, max(likes) as likes, max(comments) as comments, max(shares) as shares, max(published_at) as published_at
from {source} group by {lead}lower(trim(platform)), case when trim(video_id) <> '' then trim(video_id) else trim(coalesce(url, '')) end"""


MERGED = f"{HITS}, merged as ({merged_sql('hits')})"
FILTERS = SearchFilters(min_views=1000, min_likes=100, max_duration_sec=300, published_within_days=20)
FILTER_SQL = """(views is null or views = 0 or views >= 1000) and coalesce(likes, 0) >= 100
  and (duration_sec is null or duration_sec <= 300) and (published_at is null or published_at >= timestamp '2024-01-11 00:00:00')"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.merge_candidates(hits(spark, sf_dir))


def candidate_dedupe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select(*FLAT)


def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.filter_candidates(merged(spark, sf_dir), FILTERS, now()).select("seq", "video_id", "platform", "views", "likes", "duration_sec", "published_at")


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.keep_first(hits(spark, sf_dir), ["platform", "search_source"], ["seq"]).select("platform", "search_source", "seq", "video_id", "title")


def distinct_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    spelled = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.concat(F.lit("  "), F.col("source"), F.lit(" ")))
    return candidates.distinct_phrases(d.select("lang", "doc_id", spelled.alias("phrase")), ["lang"], "phrase", ["doc_id"])


def fill_by_id_or_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = [document_hits(spark, sf_dir), event_hits(spark, sf_dir)]
    return candidates.by_id_or_url(tiers, ["platform"], 60).select("platform", "video_id", "seq", "search_source")


def fill_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = lambda url, add: pages.select((F.col("page_id") * 2 + add).alias("seq"), F.regexp_extract("url", "^(https?)", 1).alias("scheme"), url.alias("url"))
    tiers = [rows(F.regexp_extract("url", "^([^?#]*)", 1), 0), rows(F.regexp_extract("url", "^([^#]*)", 1), 1)]
    return candidates.by_url(tiers, ["scheme"], 100)


def image_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.triage(candidates.merge_candidates(event_hits(spark, sf_dir))).select("video_id", "platform", "media_type", "accepted", "reason")


def processable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.processable(hits(spark, sf_dir)).groupBy("platform", "search_source").agg(F.count(F.lit(1)).alias("n"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = candidates.filter_candidates(merged(spark, sf_dir), SearchFilters(max_duration_sec=300), now())
    return ranking.score(kept, F.lit(QUERY), now())


def trend_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: merge arrivals, filter, score, first thirty."""
    return ranking.top(_scored(spark, sf_dir), "overall", 30).select(*SCORE_COLUMNS)


def rank_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(*SCORE_COLUMNS)


def rank_sort_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    modes = ["latest", "likes", "views", "affiliate", "anything else"]
    return ranking.top_per_mode(scored, modes, 10).select("mode", "seq", "video_id")


def rank_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = hits(spark, sf_dir).withColumn("query", F.col("search_source"))
    scored = ranking.score(candidates.merge_candidates(keyed, ["query"]), F.col("query"), now(), ["query"])
    return ranking.top_per_query(scored, ["query"], "overall", 30).select("query", "rank", *SCORE_COLUMNS)


def score_sql(source: str, query: str, by: str = "") -> str:
    """The score columns over a table of candidates, as SQL."""
    weights = " ".join(f"when {quoted(k)} then {v}::double" for k, v in rules.PLATFORM_WEIGHTS.items())
    terms = " + ".join(f"cast(contains(words, {quoted(t)}) as int)" for t in rules.INTENT_TERMS)
    over = f"(partition by {by})" if by else "()"
    pct = lambda v, name: f"round({v} * 100 * 10) / 10 as {name}"
    return f"""raw as (select *, ln(1 + coalesce(likes, 0)::double + 2 * coalesce(comments, 0)::double + 3 * coalesce(shares, 0)::double + 0.01::double * coalesce(views, 0)::double) as e0,
    date_diff('microsecond', published_at, {NOW_SQL}) / 3.6e9 as age, {query} as q,
    lower(coalesce(title, '') || ' ' || coalesce(author, '') || ' ' || coalesce(search_source, '')) as hay,
    lower(coalesce(title, '') || ' ' || coalesce(search_source, '')) as words from {source}),
  vel as (select *, e0 / case when published_at is null then 720.0 else greatest(1.0, age) end as v0,
    list_filter(regexp_split_to_array(lower(q), '[\\s\\p{{Z}}\\p{{P}}]+'), lambda t: length(t) >= 2) as toks, {terms} as hits_n from raw),
  tops as (select *, max(e0) over {over} as te, max(v0) over {over} as tv from vel),
  parts as (select *, case when te > 0 then least(1.0, e0 / te) else 0.0 end as e, case when tv > 0 then least(1.0, v0 / tv) else 0.0 end as v,
    case when published_at is null then 0.35::double else exp(-greatest(0.0, age) / 336.0) end as r,
    case when len(toks) = 0 then 0.5::double when contains(lower(coalesce(title, '')), lower(trim(q))) then 1.0::double
      when trim(coalesce(search_source, '')) <> '' and lower(trim(search_source)) <> lower(trim(q))
        then greatest(0.75::double, len(list_filter(toks, lambda t: contains(hay, t))) / len(toks)::double)
      else len(list_filter(toks, lambda t: contains(hay, t))) / len(toks)::double end as m,
    0.55::double * case lower(trim(platform)) {weights} else 0.5::double end
      + 0.30::double * case when hits_n = 0 then 0.35::double else least(1.0::double, 0.25::double * hits_n) end
      + 0.15::double * case when coalesce(duration_sec, 0) <= 0 then 0.55::double when duration_sec <= 90 then 1.0::double
          when duration_sec <= 180 then 0.88::double when duration_sec <= 300 then 0.65::double else 0.40::double end as a from tops),
  mixed as (select *, 0.45::double * e + 0.35::double * r + 0.20::double * v as t from parts),
  scored as (select *, {pct('e', 'engagement')}, {pct('r', 'recency')}, {pct('m', 'relevance')}, {pct('a', 'affiliate')}, {pct('t', 'trend')},
    {pct('(0.32::double * t + 0.24::double * m + 0.14::double * e + 0.30::double * a)', 'overall')} from mixed)"""


KEPT = f"{MERGED}, kept as (select * from merged where duration_sec is null or duration_sec <= 300)"
SCORED = f"{KEPT}, {score_sql('kept', quoted(QUERY))}"
MODE_KEYS = {"latest": "coalesce(epoch_us(published_at) // 1000000, 0)", "likes": "coalesce(likes, 0)", "views": "coalesce(views, 0)",
             "affiliate": "affiliate", "anything else": "overall"}


def channel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    author = F.concat(F.lit(" @"), F.upper("source"), F.lit("_"), F.col("lang"), F.lit("·Clips"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), author.alias("author"), F.col("text").alias("title"), "lang")


def channel_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.of_channel(channel_names(spark, sf_dir), "src7 -  EN clips").select("seq", "author", "title")


def channel_match_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creators of any document that is marked toxic, wanted in another spelling, and all that they made."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    wanted = d.select(F.concat(F.lit("@"), F.col("source"), F.lit(" • "), F.col("lang"), F.lit(" - clips")).alias("channel"))
    return candidates.of_channels(channel_names(spark, sf_dir), wanted).select("seq", "author", "lang")


def phrase_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("topic"))
    return search.expand_topics(topics, "topic", expansion_limit(8))


EXPANDED = "rules(grp, marker, phrase) as (values {}), topics as (select doc_id, trim(text) as topic from documents), " .format(
    ", ".join(f"({g}, {quoted(m)}, {quoted(p)})" for g, (ms, ps) in enumerate(rules.EXPANSION_RULES) for m in ms for p in ps)
) + """found as (select distinct doc_id, topic, phrase from topics join rules on contains(lower(topic), marker) where lower(phrase) <> lower(topic)),
ranked as (select doc_id, phrase, row_number() over (partition by doc_id order by phrase collate "C") as phrase_no from found),
expanded as (select doc_id, 0 as phrase_no, topic as phrase from topics union all select doc_id, phrase_no, phrase from ranked where phrase_no <= 7)"""


def search_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's source is a search request for its expanded text over a few sources, one of them unknown."""
    d = table(spark, sf_dir, "documents")
    requests = search.with_phrases(d, "text", expansion_limit(0)).select(
        "doc_id", "phrases",
        F.array(F.lit(" Weibo"), F.lit("bilibili"), F.lit("weibo"), F.lit("nosuch"), F.lit("")).alias("sources"), (F.col("n_chars") % 120).cast("int").alias("limit"),
    )
    return search.fan_out(requests)


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages and every word of part names searched in the texts of all documents."""
    d = table(spark, sf_dir, "documents")
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("phrase_id"), F.col("text").alias("phrase"))
    words = table(spark, sf_dir, "part").select(F.col("p_name").alias("phrase_id"), F.explode(F.split("p_name", " ")).alias("phrase")).distinct()
    found = search.phrase_matches(d, ["doc_id"], "text", b.unionByName(words))
    return found.select("doc_id", "phrase_id")


def phrase_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of three words of the benchmark passages, and every part name, joined with all texts by their rarest grams."""
    d = table(spark, sf_dir, "documents")
    words = F.split(F.trim("text"), " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, 3), " "))
    b = table(spark, sf_dir, "benchmark").where(F.size(words) >= 3).select(F.explode(runs).alias("phrase"))
    phrases = b.unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("phrase"))).distinct()
    found = search.phrase_matches(d, ["doc_id"], "text", phrases.withColumn("phrase_id", F.col("phrase")), 0)
    return found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_texts"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def phrase_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First ten hits per channel and passage, in arrival order."""
    d = table(spark, sf_dir, "documents")
    phrases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    found = search.phrase_matches(d, ["doc_id", "source"], "text", phrases).withColumn("seq", F.col("doc_id"))
    return search.limit_per_phrase(found, 10).select("source", "phrase_id", "doc_id", "hit_no")


PLATFORMS = ["weibo", "bilibili", "douyin"]
SEARCH_GROUPS = [(["than"], ["ing of", "Of The"]), (["camp"], ["never"])]


def _request(spark: SparkSession, sf_dir: str, topic: str, mode: str) -> DataFrame:
    """A request over three registered sources and an unknown one: expand, fan out, search, limit, merge, filter, rank."""
    every = hits(spark, sf_dir)
    for name in PLATFORMS:
        registry.register(registry.LandedSource(name, every.where(F.col("platform") == name), ("title", "author")))
    found, _ = registry.search_request(spark, topic, [f" {PLATFORMS[0].upper()}", *PLATFORMS[1:], "nosuch"], 60, mode, groups=SEARCH_GROUPS)
    kept = candidates.merge_candidates(found)
    if mode == "channel":
        kept = candidates.of_channel(kept, topic)
    kept = candidates.filter_candidates(kept, SearchFilters(max_duration_sec=300), now())
    return ranking.top(ranking.score(kept, F.lit(topic), now()), "overall", 60).select(*SCORE_COLUMNS)


def search_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _request(spark, sf_dir, "than", "keyword")


def search_pipeline_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _request(spark, sf_dir, "src1", "channel")


def _request_sql(topic: str, phrases: list[str], most: int, condition: str) -> str:
    wanted = ", ".join(f"({i}, {quoted(p.lower())})" for i, p in enumerate(phrases))
    places = ", ".join(map(quoted, PLATFORMS))
    return _with(f"""{HITS}, wanted(no, needle) as (values {wanted}),
asked as (select h.*, row_number() over (partition by platform, no order by seq) as k from hits h join wanted on contains(lower(concat_ws(chr(10), title, author)), needle) where platform in ({places})),
found as (select distinct * exclude (k) from asked where k <= {most}), merged as ({merged_sql('found')}),
kept as (select * from merged where (duration_sec is null or duration_sec <= 300) and {condition}), {score_sql('kept', quoted(topic))}""",
        f"select {', '.join(SCORE_COLUMNS)} from scored order by overall desc, seq limit 60")


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.source_counts(hits(spark, sf_dir).withColumn("source", F.col("platform")))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("seq"), F.concat_ws("/", F.when(F.col("event_type").isin("error", "view"), "e").otherwise("o"), F.col("user_id").cast("string"), (F.col("event_id") % 40).cast("string")).alias("source"),
        F.concat(F.lit("topic "), (F.col("user_id") % 3).cast("string")).alias("keyword"),
        F.when(failed, F.concat(F.lit("HTTP "), F.get_json_object("props", "$.k"))).alias("error"), F.when(failed, 0).otherwise(F.col("event_id") % 3).alias("n_results"),
    )


def source_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.error_summary(_runs(spark, sf_dir))


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents landed as JSON lines, some lines broken, some without id or address."""
    d = table(spark, sf_dir, "documents")
    line = F.to_json(F.struct(
        F.when(F.col("doc_id") % 13 == 0, F.lit(" ")).otherwise(F.concat(F.lit("BV"), F.col("doc_id"))).alias("bvid"), F.col("text").alias("title"),
        F.col("source").alias("owner_name"), F.col("n_chars").alias("duration_seconds"), (F.col("n_chars") * 3).alias("view_count"),
        (F.col("doc_id") % 7).alias("like_count"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 1_700_000_000).otherwise(0).alias("pubdate"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://v.example.com/"), F.col("doc_id"))).otherwise("").alias("url"),
    ))
    return d.select(F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("#"), line)).otherwise(line).alias("value"))


LANDED = ["seq", "video_id", "platform", "title", "author", "url", "duration_sec", "views", "likes", "search_source"]


def json_line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = landed.candidates_from_json_lines(_json_lines(spark, sf_dir), F.lit("kitchen"))
    return out.select(*LANDED, F.unix_seconds("published_at").alias("published_s"))


def json_line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines written as text files and read again, numbered in file order."""
    path = work_dir(spark, "json-lines")
    _json_lines(spark, sf_dir).repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(path)
    out = landed.read_json_lines(spark, path, "kitchen")
    return out.select(*LANDED, F.unix_seconds("published_at").alias("published_s"))


def json_line_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines through the landed_lines format, which answers the conditions on likes and address itself."""
    path = work_dir(spark, "json-lines")
    _json_lines(spark, sf_dir).select("value").write.text(path)
    out = landed.read_landed_lines(spark, path, "kitchen", (F.col("like_count") >= 3) & (F.col("url") != ""))
    return out.select(*LANDED[1:], F.unix_seconds("published_at").alias("published_s"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    item = F.struct(
        (F.col("doc_id") - F.col("doc_id") % 3 + 10_000_000).cast("string").alias("aweme_id"), F.when(F.col("doc_id") % 4 == 0, F.lit(" ")).otherwise(F.col("text")).alias("desc"),
        (F.col("doc_id") % 2 * 1_700_000_000).alias("create_time"), F.struct(F.col("source").alias("nickname")).alias("author"),
        F.struct(F.col("n_chars").alias("play_count"), (F.col("n_chars") % 9).alias("digg_count"), (F.col("doc_id") % 5).alias("comment_count"), F.lit(1).alias("share_count")).alias("statistics"),
        F.struct((F.col("n_chars") * 2).alias("duration"), F.struct(F.array(F.concat(F.lit("https://i.example.com/"), F.col("doc_id"))).alias("url_list")).alias("cover")).alias("video"),
    )
    return d.select("doc_id", "source", "lang", item.alias("item"))


ITEM_COLUMNS = ["video_id", "title", "author", "url", "views", "likes", "comments", "shares", "duration_sec", "thumbnail", "search_source"]
ITEM_SQL = """cast(doc_id - doc_id % 3 + 10000000 as varchar) as video_id, case when doc_id % 4 = 0 or trim(text) = '' then 'Douyin search: coffee' else trim(text) end as title, source as author,
  concat('https://www.douyin.com/video/', doc_id - doc_id % 3 + 10000000) as url, nullif(n_chars, 0) as views, nullif(n_chars % 9, 0) as likes, nullif(doc_id % 5, 0) as comments, 1 as shares,
  case when n_chars * 2 >= 1000 then n_chars * 2 // 1000 else nullif(n_chars * 2, 0) end as duration_sec, concat('https://i.example.com/', doc_id) as thumbnail,
  'coffee' as search_source, case when doc_id % 2 = 1 then 1700000000 end as published_s"""


def search_json_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.lit(0).alias("status_code"), F.array(F.struct(F.lit(1).alias("type"), F.col("item").alias("aweme_info"))).alias("data")))
    pages = _items(spark, sf_dir).select("doc_id", body.alias("body"))
    return landed.search_page_candidates(pages, "body", ["doc_id"], F.lit("coffee")).select("doc_id", *ITEM_COLUMNS, F.unix_seconds("published_at").alias("published_s"))


def deep_json_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items nested at changing depth, first one per id and channel language."""
    wrapped = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.struct(F.array(F.struct(F.col("item").alias("aweme"))).alias("list")).alias("x")))) \
        .otherwise(F.to_json(F.array(F.struct(F.struct(F.col("item").alias("card")).alias("y")))))
    pages = _items(spark, sf_dir).select("doc_id", "lang", wrapped.alias("body"))
    return landed.deep_candidates(pages, "body", "doc_id", ["lang"], F.lit("coffee")).select("lang", "doc_id", *ITEM_COLUMNS, F.unix_seconds("published_at").alias("published_s"))


def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "error", 2483).when(F.col("event_type") == "click", 500).otherwise(0)
    body = F.when(F.col("event_id") % 10 == 0, F.lit("<html>")).otherwise(F.to_json(F.struct(code.alias("status_code"), F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")).alias("status_msg"))))
    return landed.search_status(e.select("event_id", body.alias("body")), "body", ["event_id"])


def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    link = F.when(F.col("event_id") % 5 == 0, F.lit("https://www.douyin.com/user/1")).otherwise(F.concat(F.lit(" https://www.douyin.com/video/"), F.col("user_id") + 10_000_000, F.lit("?x=1")))
    links = e.select(F.col("event_id").alias("seq"), "event_type", link.alias("link"))
    return landed.link_candidates(links, F.col("event_type"), ["event_type"], 40).select("event_type", "seq", "video_id", "title", "url")


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(
        F.lit("<item><title>"), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat("source", F.lit(" &amp;amp; more - 抖音"))),
        F.lit("</title><link>https://www.douyin.com/video/"), F.floor(F.col("doc_id") / 2) + 10_000_000, F.lit("?a=1&amp;b=2</link><description>"), safe, F.lit("</description></item>"))
    return landed.feed_items(d.select(F.col("doc_id").alias("seq"), "lang", xml.alias("xml")), "xml", ["seq", "lang"])


def feed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.feed_candidates(_feed(spark, sf_dir), F.col("lang"), ["lang"]).select("lang", "seq", "video_id", "title", "url", "search_source")


def feed_index_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.index_items(_feed(spark, sf_dir), ["seq"])


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractor metadata of every document merged over its candidate row."""
    d = table(spark, sf_dir, "documents")
    body = F.to_json(F.struct(
        F.concat(F.lit("m"), F.col("doc_id")).alias("id"), F.when(F.col("doc_id") % 4 == 0, F.lit("Login - clips")).otherwise(F.concat("text", F.lit(" (clip)"))).alias("title"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.concat("source", F.lit("!"))).alias("uploader"), F.col("lang").alias("channel"), F.lit("").alias("thumbnail"),
        (F.col("n_chars") / 7.0).alias("duration"), (F.col("doc_id") % 10).alias("view_count"), F.col("n_chars").alias("like_count"),
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 1_700_000_000).otherwise(0).alias("timestamp"), F.lit("20240115").alias("upload_date"),
        F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("f1"))).alias("formats"),
        F.array(F.struct(F.concat(F.lit("https://t.example.com/"), F.col("doc_id")).alias("url")), F.struct(F.lit(" ").alias("url"))).alias("thumbnails"),
    ))
    updates = landed.metadata_updates(d.select((F.col("doc_id") * 2).alias("seq"), body.alias("body")), "body", ["seq"])
    original = document_hits(spark, sf_dir).withColumn("published_at", F.col("published_at").cast("timestamp"))
    out = candidates.merge_preview(original, updates)
    return out.select("seq", "video_id", "title", "author", "thumbnail", "media_type", "duration_sec", "views", "likes", F.unix_seconds("published_at").alias("published_s"))


def _with(ctes: str, body: str) -> str:
    return f"with {ctes} {body}"


CHANNELS = """names as (select doc_id as seq, ' @' || upper(source) || '_' || lang || '·Clips' as author, text as title, lang from documents),
normed as (select *, trim(regexp_replace(lower(regexp_replace(trim(author), '^@', '')), '[\\s_\\-·•]+', ' ', 'g')) as norm from names)"""
LINES = """from documents where doc_id % 11 <> 0 and doc_id % 13 <> 0"""

QUERIES = {
    "candidate_dedupe_merge": (candidate_dedupe_merge, _with(MERGED, f"select {', '.join(FLAT)} from merged")),
    "candidate_filter": (candidate_filter, _with(MERGED, f"select seq, video_id, platform, views, likes, duration_sec, published_at from merged where {FILTER_SQL}")),
    "first_seen": (first_seen, _with(HITS, "select platform, search_source, min(seq) as seq, arg_min(video_id, seq) as video_id, first(title order by seq) as title from hits group by platform, search_source")),
    "distinct_phrases": (distinct_phrases, """with p as (select lang, doc_id, case when doc_id % 2 = 0 then upper(source) else '  ' || source || ' ' end as phrase from documents)
select lang, min(doc_id) as doc_id, arg_min(phrase, doc_id) as phrase from p group by lang, lower(trim(phrase))"""),
    "union_fill_by_id": (fill_by_id_or_url, _with(HITS + """, tiers as (select *, 0 as tier from doc_hits union all select *, 1 as tier from event_hits),
firsts as (select *, row_number() over (partition by platform, coalesce(nullif(trim(video_id), ''), nullif(trim(url), '')) order by tier, seq) as k from tiers),
kept as (select *, row_number() over (partition by platform order by tier, seq) as n from firsts where k = 1)""", "select platform, video_id, seq, search_source from kept where n <= 60")),
    "union_fill_by_url": (fill_by_url, """with tiers as (select page_id * 2 as seq, regexp_extract(url, '^(https?)', 1) as scheme, regexp_extract(url, '^([^?#]*)', 1) as url, 0 as tier from pages
union all select page_id * 2 + 1, regexp_extract(url, '^(https?)', 1), regexp_extract(url, '^([^#]*)', 1), 1 from pages),
firsts as (select *, row_number() over (partition by scheme, url order by tier, seq) as k from tiers where url <> ''),
kept as (select *, row_number() over (partition by scheme order by tier, seq) as n from firsts where k = 1) select seq, scheme, url from kept where n <= 100"""),
    "image_triage": (image_triage, _with(f"{HITS}, m as ({merged_sql('event_hits')})", "select video_id, platform, media_type, media_type <> 'image' as accepted, case when media_type = 'image' then 'image post' end as reason from m")),
    "processable": (processable, _with(HITS, "select platform, search_source, count(*) as n from hits where coalesce(media_type, '') <> 'image' group by all")),
    "trend_topn": (trend_topn, _with(SCORED, f"select {', '.join(SCORE_COLUMNS)} from scored order by overall desc, seq limit 30")),
    "rank_full": (rank_full, _with(SCORED, f"select {', '.join(SCORE_COLUMNS)} from scored")),
    "rank_sort_modes": (rank_sort_modes, _with(SCORED, " union all ".join(
        f"(select {quoted(m)} as mode, seq, video_id from scored order by {k} desc, seq limit 10)" for m, k in MODE_KEYS.items()))),
    "rank_multi_query": (rank_multi_query, _with(
        f"{HITS}, keyed as (select *, search_source as query from hits), merged as ({merged_sql('keyed', 'query')}), {score_sql('merged', 'query', 'query')}, "
        "ranked as (select *, row_number() over (partition by query order by overall desc, seq) as rank from scored)",
        f"select query, rank, {', '.join(SCORE_COLUMNS)} from ranked where rank <= 30")),
    "channel_match": (channel_match, _with(CHANNELS, "select seq, author, title from normed where norm = 'src7 en clips'")),
    "channel_match_many": (channel_match_many, _with(CHANNELS, "select seq, author, lang from normed where norm in (select source || ' ' || lang || ' clips' from documents where doc_id in (select doc_id from labels where toxic = 1))")),
    "phrase_expand": (phrase_expand, _with(EXPANDED, "select doc_id, phrase_no, phrase from expanded")),
    "search_fanout": (search_fanout, _with(EXPANDED + """, sized as (select doc_id, least(max(phrase_no) + 1, 4) as n from expanded group by doc_id),
req as (select d.doc_id, cast(greatest(10, ceil((case when d.n_chars % 120 <= 0 then 30 else least(d.n_chars % 120, 100) end) / s.n::double)) as int) as query_limit from documents d join sized s using (doc_id))""", """select doc_id, source, query_limit, cast(null as varchar) as error, phrase_no, phrase from req join expanded using (doc_id) cross join (values ('weibo', 3), ('bilibili', 4)) as s(source, cap) where phrase_no < cap
union all select doc_id, 'nosuch', query_limit, 'unknown source', 0, null from req""")),
    "phrase_search": (phrase_search, """with phrases as (select 'b' || item_id as phrase_id, text as phrase from benchmark union all select distinct p_name, unnest(string_split(p_name, ' ')) from part)
select doc_id, phrase_id from documents join phrases on contains(lower(text), lower(trim(phrase)))"""),
    "phrase_search_index": (phrase_search_index, """with b as (select string_split(trim(text), ' ') as ws from benchmark),
phrases as (select array_to_string(ws[i:i + 2], ' ') as phrase from (select ws, unnest(range(1, len(ws) - 1)) as i from b) union select p_name from part)
select phrase, count(*) as n_texts, min(doc_id) as first_doc, max(doc_id) as last_doc
from documents join phrases on contains(lower(text), lower(trim(phrase))) where trim(phrase) <> '' group by phrase"""),
    "phrase_search_topk": (phrase_search_topk, """with found as (select source, item_id as phrase_id, doc_id, row_number() over (partition by source, item_id order by doc_id) as hit_no
from documents d join benchmark b on contains(lower(d.text), lower(trim(b.text)))) select * from found where hit_no <= 10"""),
    "search_pipeline": (search_pipeline, _request_sql("than", ["than", "Of The", "ing of"], 20, "true")),
    "search_pipeline_channel": (search_pipeline_channel, _request_sql("src1", ["src1"], 100, "author = 'src1'")),
    "source_counts": (source_counts, _with(HITS, "select platform as source, count(*) as n from hits group by platform")),
    "source_errors": (source_errors, """with runs as (select event_id as seq, (case when event_type in ('error', 'view') then 'e' else 'o' end) || '/' || user_id || '/' || (event_id % 40) as source,
  'topic ' || (user_id % 3) as keyword, case when event_type = 'error' then 'HTTP ' || json_extract_string(props, '$.k') end as error, case when event_type = 'error' then 0 else event_id % 3 end as n from events),
msgs as (select source, keyword || ': ' || error as message, min(seq) as first_seq from runs where error is not null group by all),
num as (select *, row_number() over (partition by source order by first_seq, message) as k, count(*) over (partition by source) as distinct_errors from msgs),
ok as (select source from runs where error is null group by source having sum(n) > 0)
select source, distinct_errors, string_agg(message, ' | ' order by k) filter (where k <= 2) || case when distinct_errors > 2 then ' | +' || (distinct_errors - 2) || ' lỗi tương tự' else '' end as summary
from num where source not in (select source from ok) group by source, distinct_errors"""),
    "json_line_candidates": (json_line_candidates, f"""select doc_id as seq, 'BV' || doc_id as video_id, 'bilibili' as platform, nullif(text, '') as title, source as author,
case when doc_id % 3 = 0 then 'https://v.example.com/' || doc_id else 'https://www.bilibili.com/video/BV' || doc_id end as url, nullif(n_chars, 0) as duration_sec, nullif(n_chars * 3, 0) as views,
nullif(doc_id % 7, 0) as likes, 'kitchen' as search_source, case when doc_id % 2 = 0 then doc_id + 1700000000 end as published_s {LINES}"""),
    "json_line_format": (json_line_format, f"""select 'BV' || doc_id as video_id, 'bilibili' as platform, nullif(text, '') as title, source as author, 'https://v.example.com/' || doc_id as url, nullif(n_chars, 0) as duration_sec,
nullif(n_chars * 3, 0) as views, nullif(doc_id % 7, 0) as likes, 'kitchen' as search_source, case when doc_id % 2 = 0 then doc_id + 1700000000 end as published_s {LINES} and doc_id % 7 >= 3 and doc_id % 3 = 0"""),
    "json_line_files": (json_line_files, f"""with n as (select *, row_number() over (order by doc_id) - 1 as place from documents) select place as seq, 'BV' || doc_id as video_id, 'bilibili' as platform, nullif(text, '') as title, source as author,
case when doc_id % 3 = 0 then 'https://v.example.com/' || doc_id else 'https://www.bilibili.com/video/BV' || doc_id end as url, nullif(n_chars, 0) as duration_sec, nullif(n_chars * 3, 0) as views,
nullif(doc_id % 7, 0) as likes, 'kitchen' as search_source, case when doc_id % 2 = 0 then doc_id + 1700000000 end as published_s {LINES.replace('from documents', 'from n')}"""),
    "search_json_candidates": (search_json_candidates, f"select doc_id, {ITEM_SQL} from documents"),
    "deep_json_candidates": (deep_json_candidates, f"with r as (select *, row_number() over (partition by lang, doc_id - doc_id % 3 order by doc_id) as k from documents) select lang, doc_id, {ITEM_SQL} from r where k = 1"),
    "search_status": (search_status, """select event_id, code, state, case when state = 'error' then 'status ' || code || ': ' || event_type end as error from (
select *, case event_type when 'error' then 2483 when 'click' then 500 else 0 end as code, case event_type when 'error' then 'login_required' when 'click' then 'error' else 'ok' end as state
from events where event_id % 10 <> 0)"""),
    "link_candidates": (link_candidates, """with f as (select event_type, user_id, min(event_id) as seq from events where event_id % 5 <> 0 group by all),
k as (select *, row_number() over (partition by event_type order by seq) as n from f)
select event_type, seq, cast(user_id + 10000000 as varchar) as video_id, 'Douyin search: ' || event_type as title, 'https://www.douyin.com/video/' || (user_id + 10000000) as url from k where n <= 40"""),
    "feed_candidates": (feed_candidates, """with r as (select *, row_number() over (partition by lang, doc_id // 2 order by doc_id) as k from documents)
select lang, doc_id as seq, cast(doc_id // 2 + 10000000 as varchar) as video_id, case when doc_id % 3 <> 0 then source || ' & more' when trim(text) = '' then 'Douyin video ' || (doc_id // 2 + 10000000) else trim(text) end as title,
'https://www.douyin.com/video/' || (doc_id // 2 + 10000000) as url, lang as search_source from r where k = 1"""),
    "feed_index_items": (feed_index_items, """select doc_id as seq, case when doc_id % 3 <> 0 then source || ' & more - 抖音' else trim(regexp_replace(regexp_replace(text, '(?is)<[^>]+>', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) end as title,
'https://www.douyin.com/video/' || (doc_id // 2 + 10000000) || '?a=1&b=2' as url from documents"""),
    "metadata_merge": (metadata_merge, _with(HITS, """select h.seq, 'm' || d.doc_id as video_id, case when d.doc_id % 4 = 0 or regexp_matches(lower(d.text), 'login|home -') then h.title else trim(d.text || ' (clip)') end as title,
case when d.doc_id % 3 = 0 then d.lang else d.source || '!' end as author, 'https://t.example.com/' || d.doc_id as thumbnail, case when d.doc_id % 5 <> 0 then 'video' end as media_type,
coalesce(nullif(cast(floor(d.n_chars / 7.0 + 0.5) as bigint), 0), h.duration_sec) as duration_sec, nullif(d.doc_id % 10, 0) as views, nullif(d.n_chars, 0) as likes,
case when d.doc_id % 2 = 0 then d.doc_id + 1700000000 else 1705276800 end as published_s from documents d join doc_hits h on h.seq = d.doc_id * 2""")),
}
