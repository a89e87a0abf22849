"""Landed search results to candidate rows: JSON lines, feeds, link lists, search JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from clipmetrics import rules, schemas
from clipmetrics.functions import text, urls
from clipmetrics.functions.text import strip
from clipmetrics.operators.candidates import keep_first
from clipmetrics.sources.formats import register_formats


def _candidate(df: DataFrame, keep: list[str], values: dict[str, Column]) -> DataFrame:
    """Select canonical columns, null where a source has nothing; blanks and zeros mean unknown."""
    types = dict(field.split(" ") for field in schemas.VIDEO_FIELDS.split(", "))
    columns = []
    for name, kind in types.items():
        value = values.get(name, F.lit(None)).cast(kind)
        if kind == "string":
            value = F.nullif(value, F.lit(""))
        elif kind == "bigint":
            value = F.nullif(value, F.lit(0).cast("bigint"))
        columns.append(value.alias(name))
    return df.select(*keep, *columns)


def positive_time(seconds: Column) -> Column:
    return F.when(seconds > 0, F.timestamp_seconds(seconds))


def limited(df: DataFrame, group: list[str], limit: int | None) -> DataFrame:
    """First rows per group in seq order; no limit keeps all."""
    if limit is None:
        return df
    order = Window.partitionBy(*group).orderBy("seq")
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def candidates_from_json_lines(lines: DataFrame, keyword: Column, column: str = "value") -> DataFrame:
    """lines(seq, value): bad lines and rows without id are skipped; a missing address comes from the id."""
    return candidates_from_rows(lines.select("seq", keyword.alias("_keyword"), F.from_json(F.col(column), schemas.JSONL_ROW).alias("j")), ["seq"])


def read_landed_lines(spark: SparkSession, path: str, keyword: str, where: Column | None = None) -> DataFrame:
    """Candidate rows with file and byte position, through the landed_lines format; where is a condition on landed fields."""
    register_formats(spark)
    lines = spark.read.format("landed_lines").load(path)
    kept = lines if where is None else lines.where(where)
    fields = [f.split(" ")[0] for f in schemas.JSONL_ROW.split(", ")]
    return candidates_from_rows(kept.select("file", "at", F.lit(keyword).alias("_keyword"), F.struct(*fields).alias("j")), ["file", "at"])


def candidates_from_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows(keep, _keyword, j) with the landed fields in j; rows without id are skipped."""
    good = rows.where(strip("j.bvid") != "")
    link = F.coalesce(text.blank_to_null(F.col("j.url")), F.concat(F.lit(rules.BILIBILI_URL), F.col("j.bvid")))
    return _candidate(good, keep, {
        "video_id": F.col("j.bvid"), "platform": F.lit("bilibili"), "title": F.col("j.title"), "author": F.col("j.owner_name"),
        "url": link, "thumbnail": F.col("j.cover_url"), "duration_sec": F.col("j.duration_seconds"), "views": F.col("j.view_count"),
        "likes": F.col("j.like_count"), "comments": F.col("j.reply_count"), "shares": F.col("j.share_count"),
        "search_source": F.col("_keyword"), "published_at": positive_time(F.col("j.pubdate")),
    })


def in_file_order(rows: DataFrame) -> DataFrame:
    """rows just read from files, with seq from 0 by file path, block and place in the block.

    However files are packed into tasks, a block is read by one task from its start on. Only one row per block is
    numbered in a single place.
    """
    block = ["_file", "_block"]
    read = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    sizes = read.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*block).orderBy("_row"))
    numbered = read.withColumn("_place", place).join(sizes.drop("_n"), block)
    return numbered.select((F.col("_before") + F.col("_place") - 1).alias("seq"), *rows.columns)


def read_json_lines(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """Candidate rows of landed JSON-line files; seq follows file order."""
    return candidates_from_json_lines(in_file_order(spark.read.text(path)), F.lit(keyword))


def read_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """item elements of landed RSS files: (seq, title, link, description); seq follows file order."""
    items = spark.read.format("xml").option("rowTag", "item").schema(schemas.RSS_ITEM).load(path)
    return in_file_order(items).select("seq", "title", "link", "description")


def feed_items(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """One item per row from an XML text column."""
    return df.select(*keep, F.from_xml(F.col(xml), schemas.RSS_ITEM).alias("i")).select(*keep, "i.*")


def feed_candidates(items: DataFrame, keyword: Column, group: list[str] | None = None, limit: int | None = None,
                    id_pattern: str = rules.DOUYIN_ID, url_prefix: str = rules.DOUYIN_URL, platform: str = "douyin") -> DataFrame:
    """items(seq, title, link, description): id from the link, first item per id, title else description else made up."""
    group = group or []
    clean = lambda c: text.strip_site_suffixes(text.unescape(F.coalesce(F.col(c), F.lit(""))))
    ident = urls.video_id(strip(text.unescape(F.col("link"))), id_pattern)
    found = items.select(*group, "seq", ident.alias("id"), "title", "description", keyword.alias("_keyword")).where(F.col("id").isNotNull())
    first = limited(keep_first(found, [*group, "id"], ["seq"]), group, limit)
    title = F.coalesce(F.nullif(clean("title"), F.lit("")), F.nullif(clean("description"), F.lit("")),
                       F.concat(F.lit(f"{platform.capitalize()} video "), F.col("id")))
    return _candidate(first, [*group, "seq"], {
        "video_id": F.col("id"), "platform": F.lit(platform), "title": title, "url": F.concat(F.lit(url_prefix), F.col("id")),
        "search_source": F.col("_keyword"),
    })


def index_items(items: DataFrame, keep: list[str]) -> DataFrame:
    """items(title, link, description) to (title, url); the description stands in for a blank title."""
    title = F.coalesce(F.nullif(text.clean_index_text(F.col("title")), F.lit("")), text.clean_index_text(F.col("description")))
    return items.select(*keep, F.coalesce(title, F.lit("")).alias("title"), strip(text.unescape(F.col("link"))).alias("url"))


def index_candidates(items: DataFrame, platform: Column, keyword: Column, group: list[str], limit: int | None = None,
                     host_rules: dict[str, rules.HostRule] | None = None) -> DataFrame:
    """items(seq, title, url) the platform accepts, by canonical address, first one kept."""
    link = urls.platform_url(platform, text.unescape(F.col("url")), host_rules)
    found = items.select(*group, "seq", "title", platform.alias("platform"), keyword.alias("_keyword"), link.alias("url"))
    first = limited(keep_first(found.where(F.col("url").isNotNull()), [*group, "url"], ["seq"]), group, limit)
    title = F.coalesce(F.nullif(text.clean_index_text(F.col("title")), F.lit("")), F.concat("platform", F.lit(" video")))
    return _candidate(first, [*group, "seq"], {
        "video_id": urls.public_id(F.col("url")), "platform": F.col("platform"), "title": title, "url": F.col("url"),
        "search_source": F.col("_keyword"),
    })


def link_candidates(links: DataFrame, keyword: Column, group: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """links(seq, link): id from the link, first one kept, generated title."""
    group = group or []
    found = links.select(*group, "seq", keyword.alias("_keyword"), urls.video_id(strip("link"), rules.DOUYIN_ID).alias("id"))
    first = limited(keep_first(found.where(F.col("id").isNotNull()), [*group, "id"], ["seq"]), group, limit)
    return _candidate(first, [*group, "seq"], {
        "video_id": F.col("id"), "platform": F.lit("douyin"), "title": F.concat(F.lit("Douyin search: "), F.col("_keyword")),
        "url": F.concat(F.lit(rules.DOUYIN_URL), F.col("id")), "media_type": F.lit("video"), "search_source": F.col("_keyword"),
    })


def whole_seconds(duration: Column) -> Column:
    """Durations of 1000 and more are milliseconds."""
    return F.when(duration >= 1000, F.floor(duration / 1000)).when(duration > 0, duration)


def item_candidates(items: DataFrame, keep: list[str], keyword: Column) -> DataFrame:
    """items(keep, a) with a parsed search item to candidates."""
    a = "a."
    return _candidate(items.withColumn("_keyword", keyword), keep, {
        "video_id": strip(a + "aweme_id"), "platform": F.lit("douyin"),
        "title": F.coalesce(text.blank_to_null(F.col(a + "desc")), F.concat(F.lit("Douyin search: "), F.col("_keyword"))),
        "author": strip(a + "author.nickname"), "url": F.concat(F.lit(rules.DOUYIN_URL), strip(a + "aweme_id")),
        "media_type": F.lit("video"), "views": F.col(a + "statistics.play_count"), "likes": F.col(a + "statistics.digg_count"),
        "comments": F.col(a + "statistics.comment_count"), "shares": F.col(a + "statistics.share_count"),
        "published_at": positive_time(F.col(a + "create_time")), "duration_sec": whole_seconds(F.col(a + "video.duration")),
        "thumbnail": F.get(F.col(a + "video.cover.url_list"), F.lit(0)), "search_source": F.col("_keyword"),
    })


def search_page_candidates(pages: DataFrame, body: str, keep: list[str], keyword: Column) -> DataFrame:
    """Search JSON of the known shape; pos is the place in the page."""
    parsed = pages.select(*keep, F.from_json(F.col(body), schemas.SEARCH_PAGE).alias("p"))
    rows = parsed.select(*keep, F.posexplode("p.data").alias("pos", "d")).select(*keep, "pos", F.col("d.aweme_info").alias("a"))
    return item_candidates(rows.where(strip("a.aweme_id") != ""), [*keep, "pos"], keyword)


def _objects(id_key: str, wrappers: tuple[str, ...]):
    def collect(body: str | None) -> list[str]:
        try:
            pending = [json.loads(body)] if body else []
        except ValueError:
            return []
        found = []
        while pending:
            node = pending.pop(0)
            if isinstance(node, dict):
                found += [node[w] for w in wrappers if isinstance(node.get(w), dict) and str(node[w].get(id_key) or "").strip()]
                if str(node.get(id_key) or "").strip():
                    found.append(node)
                node = [child for key, child in node.items() if key not in wrappers]
            if isinstance(node, list):
                pending = [child for child in node if isinstance(child, (dict, list))] + pending
        return [json.dumps(item, ensure_ascii=False) for item in found]

    @F.pandas_udf(ArrayType(StringType()))
    def objects(bodies: pd.Series) -> pd.Series:
        return bodies.map(collect)

    return objects


def find_objects(pages: DataFrame, body: str, keep: list[str], id_key: str = "aweme_id",
                 wrappers: tuple[str, ...] = ("aweme_info", "aweme")) -> DataFrame:
    """Every object with an id (or under a wrapper key) at any depth of a JSON text: (keep, pos, object)."""
    return pages.select(*keep, F.posexplode(_objects(id_key, wrappers)(F.col(body))).alias("pos", "object"))


def deep_candidates(pages: DataFrame, body: str, page_order: str, group: list[str], keyword: Column) -> DataFrame:
    """Candidates from JSON of unknown shape, first one per id over all pages of a group."""
    objects = find_objects(pages, body, [*group, page_order])
    parsed = objects.withColumn("a", F.from_json("object", schemas.SEARCH_ITEM)).where(strip("a.aweme_id") != "")
    first = keep_first(parsed.withColumn("_id", strip("a.aweme_id")), [*group, "_id"], [page_order, "pos"])
    return item_candidates(first, [*group, page_order, "pos"], keyword)


def search_status(pages: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Status of search responses: ok, login required, or an error with its message; unreadable bodies are dropped."""
    code = F.coalesce(F.get_json_object(body, "$.status_code").try_cast("bigint"), F.lit(None).cast("bigint"))
    rows = pages.where(F.try_parse_json(body).isNotNull()).select(*keep, code.alias("code"), F.get_json_object(body, "$.status_msg").alias("msg"))
    state = F.when(F.col("code").isNull() | (F.col("code") == 0), "ok").when(F.col("code") == rules.LOGIN_STATUS, "login_required").otherwise("error")
    error = F.when(state == "error", F.concat(F.lit("status "), F.col("code").cast("string"), F.lit(": "), strip(F.coalesce("msg", F.lit("")))))
    return rows.select(*keep, "code", state.alias("state"), error.alias("error"))


def metadata_updates(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Extractor metadata JSON to the values it may set on a candidate, null where it says nothing."""
    m = df.select(*keep, F.from_json(F.col(column), schemas.METADATA).alias("m"))
    title = text.blank_to_null(F.col("m.title"))
    shots = F.filter(F.transform("m.thumbnails", lambda t: strip(t.url)), lambda u: u != "")
    date = F.when(F.length("m.upload_date") == 8, F.try_to_timestamp("m.upload_date", F.lit("yyyyMMdd")))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return _candidate(m, keep, {
        "video_id": F.col("m.id"), "title": F.when(~text.is_generic_title(title), title),
        "author": F.coalesce(text.blank_to_null(F.col("m.uploader")), text.blank_to_null(F.col("m.channel"))),
        "thumbnail": F.coalesce(text.blank_to_null(F.col("m.thumbnail")), F.get(shots, F.size(shots) - 1)),
        "media_type": F.when(F.size("m.formats") > 0, "video"), "duration_sec": F.when(F.col("m.duration") > 0, F.floor(F.col("m.duration") + 0.5)),
        "views": positive("m.view_count"), "likes": positive("m.like_count"), "comments": positive("m.comment_count"),
        "published_at": F.coalesce(positive_time(F.col("m.timestamp")), date),
    })
