"""Landed web pages: anchors, video links, meta tags, media links."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clipmetrics import rules, schemas
from clipmetrics.functions import text, urls
from clipmetrics.functions.text import strip
from clipmetrics.operators.candidates import keep_first


def _groups(document: Column, pattern: str, *indexes: int) -> Column:
    """Array of structs with the wanted groups of every match, in document order."""
    if len(indexes) == 1:
        return F.regexp_extract_all(document, F.lit(pattern), F.lit(indexes[0]))
    parts = [F.regexp_extract_all(document, F.lit(pattern), F.lit(i)).alias(f"g{n}") for n, i in enumerate(indexes)]
    return F.arrays_zip(*parts)


def anchors(pages: DataFrame, keep: list[str], html: str = "html", limit: int | None = None) -> DataFrame:
    """(text, href) of every anchor in order; hrefs are unwrapped from redirects, anchors without target dropped."""
    found = _groups(F.col(html), rules.ANCHOR, 1, 2)
    rows = pages.select(*keep, F.posexplode(found).alias("pos", "a"))
    href = urls.unwrap_redirect(text.unescape(F.col("a.g0")))
    out = rows.select(*keep, "pos", text.clean_index_text(F.col("a.g1")).alias("text"), href.alias("href")).where(F.col("href") != "")
    if limit is None:
        return out
    order = Window.partitionBy(*keep).orderBy("pos")
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def _near(document: Column, ident: Column) -> Column:
    """The text around the first place of an id."""
    at = F.instr(document, ident)
    start = F.greatest(F.lit(1), at - rules.NEARBY_BEFORE)
    return F.when(at > 0, F.substring(document, start, at + rules.NEARBY_AFTER - start))


def _bare_ids(ids: Column, number: int, near: bool) -> Column:
    return F.transform(ids, lambda v, i: _found(number, i, v, F.lit(""), near))


def _found(number: int, pos: Column, ident: Column, label: Column, near: bool) -> Column:
    around = _near(F.col("_doc"), ident) if near else F.lit(None).cast("string")
    return F.struct(F.lit(number).alias("pass"), pos.alias("pos"), ident.alias("id"), label.alias("label"), around.alias("near"))


def video_links(pages: DataFrame, keep: list[str], keyword: Column, html: str = "html", anchor: str = rules.KUAISHOU_ANCHOR,
                path: str = rules.KUAISHOU_ID, url_prefix: str = rules.KUAISHOU_URL, platform: str = "kuaishou",
                embedded: str | None = None, anchor_has_id: bool = False, near: bool = False) -> DataFrame:
    """Videos linked from a rendered page: anchors with their text, then bare paths, then embedded ids; first id wins.

    With near the text around each id comes along, cut out inside the page's row.
    """
    doc = text.unescape(F.col(html))
    doc = text.unescape_slashes(doc) if embedded else F.replace(doc, F.lit("\\/"), F.lit("/"))
    base = pages.select(*keep, keyword.alias("_keyword"), doc.alias("_doc"))
    link = _groups(F.col("_doc"), anchor, 1, 2)
    passes = [F.transform(link, lambda a, i: _found(0, i, a.g0, a.g1, near))]
    for n, pattern in enumerate([path] + ([embedded] if embedded else []), start=1):
        ids = F.regexp_extract_all(F.col("_doc"), F.lit(pattern), F.lit(1))
        passes.append(_bare_ids(ids, n, near))
    rows = base.select(*keep, "_keyword", F.explode(F.concat(*passes)).alias("v")).select(*keep, "_keyword", "v.*")
    if not anchor_has_id:
        rows = rows.withColumn("id", F.when(F.col("pass") == 0, urls.video_id(F.col("id"), path)).otherwise(F.col("id")))
    rows = rows.withColumn("id", strip("id")).where(F.col("id") != "")
    first = keep_first(rows, [*keep, "id"], ["pass", "pos"])
    clean = text.clean_page_text if embedded else text.clean_index_text
    title = F.coalesce(F.nullif(clean(F.col("label")), F.lit("")), F.concat(F.lit(f"{platform.capitalize()} search: "), F.col("_keyword")))
    return first.select(
        *keep, "pass", "pos", F.col("id").alias("video_id"), F.lit(platform).alias("platform"), title.alias("title"),
        F.concat(F.lit(url_prefix), F.col("id")).alias("url"), F.lit("video").alias("media_type"), F.col("_keyword").alias("search_source"),
        *([F.col("near").alias("_near")] if near else []),
    )


def _decoded(raw: Column) -> Column:
    """Escaped JSON string content to text, unchanged when it does not decode."""
    parsed = F.get(F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>"), F.lit(0))
    return F.coalesce(parsed, raw)


def nearby_metadata(rows: DataFrame, document: str, ident: str) -> DataFrame:
    """Fields scraped from the text around an id: rows with document and id gain title, author, counters, date, duration."""
    return _metadata(rows.withColumn("_near", _near(F.col(document), F.col(ident))))


def _metadata(found: DataFrame) -> DataFrame:
    """The fields of the text in _near."""
    number = lambda name: F.regexp_extract("_near", rf"""(?i)\\?["']{name}\\?["']\s*:\s*([0-9]+)""", 1).try_cast("bigint")
    word = lambda name: text.blank_to_null(text.unescape(_decoded(F.regexp_extract("_near", rules.NEARBY_TEXT[name], 1))))
    known = lambda name: F.nullif(number(rules.NEARBY_NUMBER[name]), F.lit(0).cast("bigint"))
    duration, created = known("duration"), known("create_time")
    return found.withColumns({
        "near_title": word("title"), "near_author": word("author"), "views": known("views"), "likes": known("likes"),
        "comments": known("comments"), "shares": known("shares"), "published_at": F.timestamp_seconds(created),
        "duration_sec": F.when(duration >= 1000, F.floor(duration / 1000)).otherwise(duration),
    }).drop("_near")


def video_ids(pages: DataFrame, keep: list[str], keyword: Column, html: str = "html") -> DataFrame:
    """Three-pass link extraction plus the metadata found near every id."""
    near = _metadata(video_links(
        pages, keep, keyword, html, rules.DOUYIN_ANCHOR, rules.DOUYIN_ID, rules.DOUYIN_URL, "douyin", rules.DOUYIN_EMBEDDED_ID, True, near=True))
    generated = F.startswith("title", F.lit("Douyin search: "))
    title = F.when(generated, F.coalesce("near_title", "title")).otherwise(F.col("title"))
    return near.withColumn("title", title).withColumnRenamed("near_author", "author").drop("near_title")


def _attribute(tag: Column, name: str) -> Column:
    pairs = _groups(tag, rules.META_ATTR, 1, 2)
    hits = F.filter(pairs, lambda p: F.lower(p.g0) == name)
    return strip(F.coalesce(F.get(hits, F.size(hits) - 1).g1, F.lit("")))


def resolve(base: Column, ref: Column) -> Column:
    """Relative reference against a page address."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(F.rlike(ref, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(urls.scheme(base), F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(root, ref))
        .otherwise(F.concat(F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder), ref))
    )


def _first(found: Column, most: int | None) -> Column:
    return found if most is None else F.slice(found, 1, most)


def page_meta(pages: DataFrame, keep: list[str], html: str = "html", url: str = "url", max_tags: int | None = None) -> DataFrame:
    """First preview image and title, media type, from the meta tags of a page, or its first max_tags."""
    tags = _first(F.regexp_extract_all(F.col(html), F.lit(rules.META_TAG), F.lit(0)), max_tags)
    entry = lambda t: F.struct(
        F.lower(F.coalesce(F.nullif(_attribute(t, "property"), F.lit("")), _attribute(t, "name"))).alias("k"), _attribute(t, "content").alias("v"))
    rows = pages.select(*keep, F.col(url).alias("_base"), F.transform(tags, entry).alias("m"))
    first = lambda *names: F.get(F.filter("m", lambda p: p.k.isin(*names) & (p.v != "")), F.lit(0)).v
    video = F.exists("m", lambda p: (p.k.isin("og:video", "og:video:url", "og:video:secure_url", "twitter:player") & (p.v != ""))
                     | ((p.k == "og:type") & F.contains(F.lower(p.v), F.lit("video"))))
    image, title = first("og:image", "twitter:image", "twitter:image:src"), first("og:title", "twitter:title")
    found = rows.select(*keep, "_base", image.alias("_image"), title.alias("_title"), F.when(video, "video").alias("media_type"))
    shown = F.nullif(strip(text.unescape(F.col("_title"))), F.lit(""))
    return found.select(
        *keep, resolve(F.col("_base"), text.unescape(F.col("_image"))).alias("image"),
        F.when(~text.is_generic_title(shown), shown).alias("title"), "media_type",
    )


def note_media_type(document: Column, url: Column) -> Column:
    """video or image from the text around the note's id (the last path part), else from the whole page."""
    ident = F.regexp_extract(url, r"([^/?#]+)/*(?:[?#].*)?$", 1)
    at = F.when(F.length(ident) >= 16, F.instr(document, ident)).otherwise(0)
    start = F.greatest(F.lit(1), at - rules.NOTE_BEFORE)
    section = F.when(at > 0, F.substring(document, start, at + rules.NOTE_AFTER - start)).otherwise(document)
    return F.when(F.rlike(section, F.lit(rules.NOTE_VIDEO)), "video").when(F.rlike(section, F.lit(rules.NOTE_IMAGE)), "image")


def _media_list(links: Column) -> Column:
    return F.array_distinct(F.filter(urls.media_urls(F.array_distinct(links)), lambda u: u.isNotNull()))


def scan_media_urls(pages: DataFrame, keep: list[str], html: str = "html", max_sources: int | None = None, max_links: int | None = None) -> DataFrame:
    """Media-looking links of a page: video elements first, then any address; distinct in order.

    All of them count, or the first max_sources elements and max_links addresses.
    """
    base = pages.select(*keep, text.unescape_slashes(text.unescape(F.col(html))).alias("_doc"))
    sources = _first(F.regexp_extract_all("_doc", F.lit(rules.VIDEO_SRC), F.lit(1)), max_sources)
    raw = _first(F.regexp_extract_all("_doc", F.lit(rules.HTTP_URL), F.lit(0)), max_links)
    kept = F.filter(_media_list(F.concat(sources, raw)), lambda u: urls.looks_like_media(u))
    return base.select(*keep, F.posexplode(kept).alias("pos", "url"))


def media_candidates(items: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Playable links of a media JSON in order of preference: bit rates from high to low, base links, templates.

    Everything stays inside the row: the lists of one item are short.
    """
    m = items.select(*keep, F.from_json(F.col(column), schemas.MEDIA).alias("m"))
    none = F.array().cast("array<string>")
    lists = lambda owner: F.flatten(F.array(*[F.coalesce(owner[k].url_list, none) for k in rules.PLAY_KEYS]))
    rated = F.transform(F.coalesce(F.col("m.bit_rate"), F.array().cast(schemas.BIT_RATES)),
                        lambda b, i: F.struct((-F.coalesce(b.bit_rate, F.lit(0))).alias("r"), i.alias("i"), lists(b).alias("u")))
    ranked = F.flatten(F.transform(F.array_sort(rated), lambda b: b.u))
    uri = F.coalesce(*[text.blank_to_null(F.col(f"m.{k}.uri")) for k in rules.PLAY_KEYS])
    head, mid, tail = rules.PLAY_TEMPLATE
    made = F.array(*[F.concat(F.lit(head), F.url_encode(uri), F.lit(mid + ratio + tail)) for ratio in rules.PLAY_RATIOS])
    every = F.concat(ranked, lists(F.col("m")), F.when(uri.isNotNull(), made).otherwise(none))
    return m.select(*keep, F.posexplode(_media_list(every)).alias("pos", "url"))


def unavailable_reason(items: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Why an item list is empty: the filter message, else a general one."""
    notice = F.coalesce(*[text.blank_to_null(F.get_json_object(column, f"$.filter_list[0].{k}")) for k in ("detail_msg", "notice")])
    empty = F.get_json_object(column, "$.item_list[0]").isNull()
    return items.where(empty).select(*keep, F.coalesce(notice, F.lit("item list was empty")).alias("reason"))


def _first_state_url(body: str | None) -> str | None:
    try:
        pending = [json.loads(body)] if body else []
    except ValueError:
        return None
    while pending:
        node = pending.pop(0)
        if isinstance(node, dict):
            for key, child in node.items():
                links = child if key.lower() == "mainmvurls" and isinstance(child, list) else []
                texts = [child] if key.lower() == "photourl" else [i.get("url") for i in links if isinstance(i, dict)]
                hit = next((t for t in texts if isinstance(t, str) and t.startswith("http")), None)
                if hit:
                    return hit
            node = list(node.values())
        if isinstance(node, list):
            pending = [child for child in node if isinstance(child, (dict, list))] + pending
    return None


@F.pandas_udf(StringType())
def _state_url(bodies: pd.Series) -> pd.Series:
    return bodies.map(_first_state_url)


def embedded_media_url(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """First media link of a page's embedded state, else of its stable fields: (keep, media_url)."""
    base = pages.select(*keep, text.unescape(F.col(html)).alias("_doc"))
    states = [_state_url(F.nullif(F.regexp_extract("_doc", p, 1), F.lit(""))) for p in rules.STATE_PATTERNS]
    plain = lambda c: F.replace(_decoded(c), F.lit("\\/"), F.lit("/"))
    photo = plain(F.regexp_extract("_doc", rules.PHOTO_URL, 1))
    listed = plain(F.regexp_extract(F.regexp_extract("_doc", rules.MAIN_URLS, 1), rules.LIST_URL, 1))
    http = lambda c: F.when(F.startswith(c, F.lit("http")), c)
    return base.select(*keep, F.coalesce(*states, http(photo), http(listed)).alias("media_url"))
