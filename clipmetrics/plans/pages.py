"""Web page queries: anchors, links, addresses, meta tags, media links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics import rules
from clipmetrics.functions import text, urls
from clipmetrics.plans.adapters import table
from clipmetrics.sources import landed, pages as ops

# The pages live on example hosts, so example rules stand for the platforms' own.
EXAMPLE_RULES = {
    "net": rules.HostRule(("example.net",), r"(?i)^/(en|fr)/"),
    "org": rules.HostRule(("example.org",), r"/[0-9]+"),
    "com": rules.HostRule(("example.com",), r"", "ref"),
}


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.anchors(table(spark, sf_dir, "pages"), ["page_id"])


def page_anchors_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.anchors(table(spark, sf_dir, "pages"), ["page_id"], limit=3)


def index_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as clean text, both orders of entity and tag handling."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.clean_index_text(F.col("html")).alias("index_text"), text.clean_page_text(F.col("html")).alias("page_text"))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", "example[.]([a-z]+)", 1).alias("platform"),
                    F.concat(F.lit(" "), "url", F.when(F.contains("url", F.lit("#")), "").when(F.contains("url", F.lit("?")), "&b=2&a=x%20y&utm_x=1&Spm=3#f").otherwise("?z=1&ref=&ref=ü&utm_campaign=q")).alias("raw"))


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _addresses(spark, sf_dir)
    canonical = urls.canonical_url(F.col("raw"))
    return rows.select("page_id", canonical.alias("canonical"), urls.host(F.trim("raw")).alias("host"), urls.public_id(canonical).alias("public_id"),
                       urls.platform_url(F.col("platform"), F.col("raw"), EXAMPLE_RULES).alias("accepted"))


def index_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as index results of their host family: accepted ones by canonical address."""
    rows = _addresses(spark, sf_dir)
    titled = rows.join(table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title")), "page_id")
    items = titled.select("platform", F.col("page_id").alias("seq"), F.when(F.col("page_id") % 3 == 0, F.lit(" <b></b> ")).otherwise(F.col("title")).alias("title"), F.trim("raw").alias("url"))
    out = landed.index_candidates(items.withColumnRenamed("platform", "family"), F.col("family"), F.lit("kw"), ["family"], None, EXAMPLE_RULES)
    return out.select("seq", "video_id", "platform", "title", "url", "search_source")


def redirect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("//duckduckgo.com/l/?kh=1&uddg="), F.url_encode("url"))).when(k == 1, F.lit("https://duckduckgo.com/y.js?ad=1")) \
        .when(k == 2, F.concat(F.lit("//"), F.regexp_replace("url", "^https?://", ""))).otherwise(F.col("url"))
    return p.select("page_id", urls.unwrap_redirect(raw).alias("target"))


def page_video_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-pass link extraction with the pages' own link shape."""
    p = table(spark, sf_dir, "pages")
    anchor = r"""(?is)<a\b[^>]*href\s*=\s*["'](/[a-z]+)["'][^>]*>(.*?)</a>"""
    out = ops.video_links(p, ["page_id"], F.lit("cats"), anchor=anchor, path=r"(?i)/([a-z]+)")
    return out.select("page_id", "pass", "pos", "video_id", "title", "url")


def _video_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with links and an embedded record of a video added to their own markup."""
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id") + 12_345_678
    record = F.concat(F.lit('<script>self.push({"aweme_id":"'), i + 2, F.lit('","nickname":"by '), F.col("page_id"), F.lit('","desc":"d '), F.col("page_id"),
                      F.lit('","play_count": '), F.col("page_id") * 3, F.lit(',\\"digg_count\\":'), F.col("page_id") % 7, F.lit(',"create_time":1700000000,"duration":15500})</script>'))
    links = F.concat(F.lit('<a class="x" href="https:\\/\\/www.douyin.com\\/video\\/'), i, F.lit('?a=1"><b>Clip &amp; more</b></a> see https:\\u002F\\u002Fwww.douyin.com\\u002Fvideo\\u002F'), i + 1, F.lit(" "))
    return p.select("page_id", F.concat("html", F.repeat(F.lit("&amp;"), F.lit(100)), links, record).alias("html"))


def page_video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.video_ids(_video_pages(spark, sf_dir), ["page_id"], F.lit("cats"))
    return out.select("page_id", "pass", "video_id", "title", "author", "views", "likes", "comments", "duration_sec", F.unix_seconds("published_at").alias("published_s"))


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with sharing tags built from their own title and address added to the head."""
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    k = F.col("page_id") % 5
    image = F.when(k == 0, F.lit("/img/a.jpg")).when(k == 1, F.lit("//cdn.example.com/b.jpg")).when(k == 2, F.lit("c.jpg?x=1&amp;y=2")).when(k == 3, F.lit("https://i.example.com/d.jpg")).otherwise("")
    tags = F.concat(F.lit("<META Property='OG:title' content='"), F.when(k == 1, F.lit("Please login")).otherwise(F.replace(title, F.lit("'"), F.lit(""))), F.lit("'><meta content=\""), image,
                    F.lit('" name="twitter:image"/><meta property="og:type" content="'), F.when(k == 2, "Video.other").otherwise("article"), F.lit('">'))
    return ops.page_meta(p.select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"), F.concat(tags, "html").alias("html")), ["page_id"])


def note_media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 4
    ident = F.concat(F.lit("66abcdef12345678"), F.col("page_id"))
    kind = F.when(k == 0, F.lit('{"type": "video"}')).when(k == 1, F.lit('{"noteType":"normal"}')).when(k == 2, F.lit('{"media" : { "stream": 1}}')).otherwise("")
    rows = p.select("page_id", F.concat(F.lit('{"type":"video"}'), F.repeat(F.lit("x"), F.lit(5000)), ident, kind, "html").alias("doc"), F.concat(F.lit("https://notes.example.com/explore/"), ident, F.lit("?s=1")).alias("url"))
    return rows.select("page_id", ops.note_media_type(F.col("doc"), F.col("url")).alias("media_type"))


def media_url_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with video elements and raw links added."""
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    extra = F.concat(F.lit('<video muted src="//v.example.com/playwm/'), i, F.lit('.mp4?a=1&amp;b=2"></video><video src="/rel.mp4"></video> http:\\/\\/v.example.com\\/play\\/'), i,
                     F.lit(" 'https://x.douyinvod.com/"), i, F.lit(");' https://other.example.com/page https://x.douyinvod.com/"), i)
    return ops.scan_media_urls(p.select("page_id", F.concat("html", extra).alias("html")), ["page_id"])


def media_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as media items: lines are bit rates, the order itself gives base links and the template id."""
    li = table(spark, sf_dir, "lineitem")
    link = lambda n: F.concat(F.lit(f"http://{n}.example.com/playwm/"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey"))
    address = F.struct(F.array(link("a"), link("b")).alias("url_list"))
    rate = F.struct(F.floor("l_extendedprice").alias("bit_rate"), address.alias("play_addr"), F.struct(F.array(link("a")).alias("url_list")).alias("play_addr_265"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    grouped = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), rate.alias("r")))).alias("g"))
    base = F.struct(F.concat(F.lit("v 0/"), "l_orderkey").alias("uri"), F.array(F.concat(F.lit("https://base.example.com/"), "l_orderkey")).alias("url_list"))
    body = F.to_json(F.struct(F.transform("g", lambda x: x.r).alias("bit_rate"), base.alias("play_addr_h264")))
    return ops.media_candidates(grouped.select("l_orderkey", body.alias("body")), "body", ["l_orderkey"])


def media_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    body = F.when(k == 0, F.lit('{"item_list":[{"a":1}]}')).when(k == 1, F.concat(F.lit('{"item_list":[],"filter_list":[{"detail_msg":"","notice":"'), "o_orderpriority", F.lit('"}]}'))).otherwise(F.lit('{"item_list":[]}'))
    return ops.unavailable_reason(o.select("o_orderkey", body.alias("body")), "body", ["o_orderkey"])


def embedded_media_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with two shapes of embedded state, a broken one and none."""
    p = table(spark, sf_dir, "pages")
    i, k = F.col("page_id"), F.col("page_id") % 5
    state = F.when(k == 0, F.concat(F.lit('<script>window.INIT_STATE = {"a":{"list":[{"photoUrl":"https://v.example.com/p'), i, F.lit('.mp4"}]}};</script>'))) \
        .when(k == 1, F.concat(F.lit('<script>window.__APOLLO_STATE__={"c":{"mainMvUrls":[{"x":1},{"url":"https://v.example.com/m'), i, F.lit('.mp4"}]}}</script>'))) \
        .when(k == 2, F.concat(F.lit("<script>window.INIT_STATE = {bad: 1, \"photoUrl\":\"https:\\/\\/v.example.com\\/r"), i, F.lit('.mp4"};</script>'))) \
        .when(k == 3, F.concat(F.lit('<script>var z = {"mainMvUrls":[{"url":"https:\\u002F\\u002Fv.example.com/u'), i, F.lit('.mp4"}]}</script>'))).otherwise("")
    return ops.embedded_media_url(p.select("page_id", F.concat("html", state).alias("html")), ["page_id"])


def media_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, rebuilt addresses and playable forms of links made from the page addresses."""
    p = table(spark, sf_dir, "pages")
    i, k = F.col("page_id") + 12_345_678, F.col("page_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("https://www.douyin.com/share/video/"), i, F.lit("?x=1"))).when(k == 1, F.concat(F.lit("https://www.douyin.com/discover?modal_id="), i)) \
        .when(k == 2, F.concat(F.lit("//v.example.com/playwm/"), i, F.lit(".mp4?mime_type=video&amp;q=1,;)"))).otherwise(F.col("url"))
    rows = p.select("page_id", F.col("url"), raw.alias("raw"))
    ident = urls.video_id(F.col("raw"), rules.DOUYIN_DOWNLOAD_ID, rules.DOUYIN_MODAL_ID)
    return rows.select("page_id", ident.alias("video_id"), F.concat(F.lit(rules.DOUYIN_URL), ident).alias("rebuilt"), urls.media_url(F.col("raw")).alias("playable"),
                       urls.captured_media_url(F.col("raw")).alias("captured"), urls.preview_host_allowed(F.lit("Douyin"), F.col("raw")).alias("preview_ok"))


def _ent(expr: str) -> str:
    """The entities the pages hold, decoded; &amp; last so nothing is decoded twice."""
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


SPACED = "[\\s\\p{Z}]+"
ANCHOR_SQL = rules.ANCHOR.replace("'", "''")
TAG_SQL = rules.TAG


def _clean(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{SPACED}', ' ', 'g'))"


ANCHORS = f"""anchors as (select page_id, unnest(regexp_extract_all(html, '{ANCHOR_SQL}', 1)) as href, unnest(regexp_extract_all(html, '{ANCHOR_SQL}', 2)) as label, unnest(range(len(regexp_extract_all(html, '{ANCHOR_SQL}', 1)))) as pos from pages),
out as (select page_id, cast(pos as int) as pos, {_clean(f"regexp_replace({_ent('label')}, '{TAG_SQL}', ' ', 'g')")} as text, {_ent('href')} as href from anchors where href <> '')"""
RAW = """raw as (select page_id, regexp_extract(url, 'example[.]([a-z]+)', 1) as platform, url || case when contains(url, '#') then '' when contains(url, '?') then '&b=2&a=x%20y&utm_x=1&Spm=3#f' else '?z=1&ref=&ref=ü&utm_campaign=q' end as raw from pages),
split as (select *, regexp_extract(raw, '^([a-z]+)://', 1) as sch, regexp_extract(raw, '://([^/?#]*)', 1) as auth, regexp_extract(raw, '://[^/?#]*([^?#]*)', 1) as path, regexp_extract(raw, '[?]([^#]*)', 1) as q from raw),
pairs as (select page_id, split_part(p, '=', 1) as k, url_decode(replace(substr(p, length(split_part(p, '=', 1)) + 2), '+', ' ')) as v, i from (select page_id, unnest(string_split(q, '&')) as p, unnest(range(len(string_split(q, '&')))) as i from split) where p <> ''),
kept as (select page_id, string_agg(k || '=' || replace(url_encode(v), '%20', '+'), '&' order by k, i) as q2 from pairs where not (lower(k) like 'utm!_%' escape '!' or lower(k) in ('spm', 'from', 'source')) group by page_id),
canon as (select s.*, sch || '://' || auth || path || case when coalesce(q2, '') <> '' then '?' || q2 else '' end as canonical, regexp_replace(lower(auth), '^www[.]', '') as host from split s left join kept using (page_id)),
judged as (select *, case when platform = 'net' and regexp_matches(path, '(?i)^/(en|fr)/') or platform = 'org' and regexp_matches(path, '/[0-9]+') or platform = 'com' and coalesce((select first(v order by i) from pairs p where p.page_id = canon.page_id and k = 'ref'), '') <> '' then canonical end as accepted from canon)"""
TITLE = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"

QUERIES = {
    "page_anchors": (page_anchors, f"with {ANCHORS} select page_id, pos, text, href from out"),
    "page_anchors_top": (page_anchors_top, f"with {ANCHORS}, r as (select *, row_number() over (partition by page_id order by pos) as n from out) select page_id, pos, text, href from r where n <= 3"),
    "index_texts": (index_texts, f"""select page_id, {_clean(f"regexp_replace({_ent('html')}, '{TAG_SQL}', ' ', 'g')")} as index_text, {_clean(_ent(f"regexp_replace(html, '{TAG_SQL}', ' ', 'g')"))} as page_text from pages"""),
    "url_canonical": (url_canonical, f"with {RAW} select page_id, canonical, host, left(sha1(canonical), 16) as public_id, accepted from judged"),
    "index_candidates": (index_candidates, f"""with {RAW}, t as (select page_id, platform, accepted, case when page_id % 3 = 0 then '' else {_clean(f"regexp_replace({_ent(TITLE)}, '{TAG_SQL}', ' ', 'g')")} end as title from judged join pages using (page_id) where accepted is not null),
f as (select *, row_number() over (partition by platform, accepted order by page_id) as k from t) select page_id as seq, left(sha1(accepted), 16) as video_id, platform, case when title = '' then platform || ' video' else title end as title, accepted as url, 'kw' as search_source from f where k = 1"""),
    "redirect_targets": (redirect_targets, """select page_id, case page_id % 4 when 0 then url when 1 then '' when 2 then 'https://' || regexp_replace(url, '^https?://', '') else url end as target from pages"""),
    "page_video_links": (page_video_links, f"""with d as (select page_id, replace({_ent('html')}, '\\/', '/') as doc from pages),
a as (select page_id, 0 as pass, unnest(regexp_extract_all(doc, '(?is)<a\\b[^>]*href\\s*=\\s*["''](/[a-z]+)["''][^>]*>(.*?)</a>', 1)) as link, unnest(regexp_extract_all(doc, '(?is)<a\\b[^>]*href\\s*=\\s*["''](/[a-z]+)["''][^>]*>(.*?)</a>', 2)) as label,
  unnest(range(len(regexp_extract_all(doc, '(?is)<a\\b[^>]*href\\s*=\\s*["''](/[a-z]+)["''][^>]*>(.*?)</a>', 1)))) as pos from d),
b as (select page_id, 1 as pass, unnest(regexp_extract_all(doc, '(?i)/([a-z]+)', 1)) as id, unnest(range(len(regexp_extract_all(doc, '(?i)/([a-z]+)', 1)))) as pos from d),
u as (select page_id, pass, pos, regexp_extract(link, '(?i)/([a-z]+)', 1) as id, label from a union all select page_id, pass, pos, id, '' from b),
f as (select *, row_number() over (partition by page_id, id order by pass, pos) as k from u where id <> ''),
g as (select *, {_clean(f"regexp_replace(label, '{TAG_SQL}', ' ', 'g')")} as t from f where k = 1)
select page_id, pass, cast(pos as int) as pos, id as video_id, case when t = '' then 'Kuaishou search: cats' else t end as title, 'https://www.kuaishou.com/short-video/' || id as url from g"""),
    "page_video_ids": (page_video_ids, """with v as (select page_id, unnest([0, 1, 2]) as n from pages)
select page_id, n as pass, cast(page_id + 12345678 + n as varchar) as video_id, case when n = 0 then 'Clip & more' else 'd ' || page_id end as title, 'by ' || page_id as author, nullif(page_id * 3, 0) as views, nullif(page_id % 7, 0) as likes, cast(null as bigint) as comments, 15 as duration_sec, 1700000000 as published_s from v"""),
    "page_meta": (page_meta, f"""with p as (select page_id, regexp_replace(url, '[?#].*$', '') as u, page_id % 5 as k, trim({_ent(f"replace({TITLE}, '''', '')")}) as t, contains(replace({TITLE}, '''', ''), '"') as quoted from pages)
select page_id, case k when 0 then regexp_extract(u, '^([a-z]+://[^/]*)', 1) || '/img/a.jpg' when 1 then regexp_extract(u, '^([a-z]+):', 1) || '://cdn.example.com/b.jpg' when 2 then regexp_replace(u, '/[^/]*$', '/') || 'c.jpg?x=1&y=2' when 3 then 'https://i.example.com/d.jpg' end as image,
case when k = 1 or regexp_matches(lower(t), 'login|home -') then null else nullif(t, '') end as title, case when k = 2 then 'video' end as media_type from p"""),
    "note_media_type": (note_media_type, "select page_id, case page_id % 4 when 0 then 'video' when 1 then 'image' when 2 then 'video' end as media_type from pages"),
    "media_url_scan": (media_url_scan, """select page_id, n as pos, case n when 0 then 'https://v.example.com/play/' || page_id || '.mp4?a=1&b=2' when 1 then 'https://v.example.com/play/' || page_id else 'https://x.douyinvod.com/' || page_id end as url from pages, (values (0), (1), (2)) as t(n)"""),
    "media_candidates": (media_candidates, """with l as (select l_orderkey, l_linenumber as n, l_partkey as p, l_suppkey as s, cast(floor(l_extendedprice) as bigint) as rate, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)) as i from lineitem),
u as (select l_orderkey, 0 as tier, -rate as a, i as b, k as c, 'https://' || h || '.example.com/play/' || l_orderkey || '-' || n || '-' || p as url from l, (values (0, 'a'), (1, 'b')) as t(k, h)
union all select l_orderkey, 1, 0, 0, 0, 'https://base.example.com/' || l_orderkey from (select distinct l_orderkey from lineitem)
union all select l_orderkey, 2, 0, 0, k, 'https://aweme.snssdk.com/aweme/v1/play/?video_id=v+0%2F' || l_orderkey || '&ratio=' || r || '&line=0' from (select distinct l_orderkey from lineitem), (values (0, '1080p'), (1, '720p'), (2, '540p'), (3, 'default')) as t(k, r)),
f as (select l_orderkey, url, min((tier, a, b, c)) as o from u group by all) select l_orderkey, cast(row_number() over (partition by l_orderkey order by o) - 1 as int) as pos, url from f"""),
    "media_unavailable": (media_unavailable, "select o_orderkey, case when o_orderkey % 3 = 1 then o_orderpriority else 'item list was empty' end as reason from orders where o_orderkey % 3 <> 0"),
    "embedded_media_url": (embedded_media_url, """select page_id, case page_id % 5 when 0 then 'https://v.example.com/p' || page_id || '.mp4' when 1 then 'https://v.example.com/m' || page_id || '.mp4' when 2 then 'https://v.example.com/r' || page_id || '.mp4' when 3 then 'https://v.example.com/u' || page_id || '.mp4' end as media_url from pages"""),
    "media_links": (media_links, """with r as (select page_id, page_id % 4 as k, page_id + 12345678 as i, url from pages)
select page_id, case when k < 2 then i::varchar end as video_id, case when k < 2 then 'https://www.douyin.com/video/' || i end as rebuilt,
case k when 0 then 'https://www.douyin.com/share/video/' || i || '?x=1' when 1 then 'https://www.douyin.com/discover?modal_id=' || i when 2 then 'https://v.example.com/play/' || i || '.mp4?mime_type=video&q=1' else regexp_replace(url, '^http://', 'https://') end as playable,
cast(null as varchar) as captured, k < 2 as preview_ok from r"""),
}
