"""Stream choice, rendition and stage planning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics.operators import media
from clipmetrics.plans.adapters import STREAMS, streams, table

CONFIG = {"transcript": ["source_size", "transcribe"], "translation": ["translate"], "speech": ["voice"]}


def stream_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.pick_streams(streams(spark, sf_dir))


def stream_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    base = F.concat(F.lit(" https://cdn.example.com/"), F.col("l_partkey"))
    backups = F.array(F.concat(F.lit("https://cdn.example.com/"), F.col("l_suppkey")), F.lit(" "), F.concat(F.lit("https://cdn.example.com/"), F.col("l_partkey")))
    return li.select("l_orderkey", "l_linenumber", F.array_join(media.link_list(base, backups), " ").alias("links"))


def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    tries = li.select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("u"), F.col("l_partkey")).alias("url"),
                      (F.col("l_returnflag") == "N").alias("ok"), F.concat(F.lit("HTTP "), F.col("l_suppkey")).alias("error"))
    return media.first_success(tries)


def rendition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    sized = p.select("p_partkey", (640 + 64 * (F.col("p_size") % 20)).cast("int").alias("width"), (360 + 40 * (F.col("p_partkey") % 40)).cast("int").alias("height"))
    out = media.plan_renditions(sized)
    return out.select("p_partkey", "aspect", "action", F.round("retention", 9).alias("retention"), "crop_w", "crop_h", "crop_x", "crop_y")


def hash_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A background track for every document, chosen among the brands."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("-"), F.col("doc_id")).alias("name"))
    return media.assign(docs, "name", table(spark, sf_dir, "part"), "p_brand")


def _items(spark: SparkSession, sf_dir: str, voice: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_id"), F.col("n_chars").alias("source_size"), F.col("lang").alias("transcribe"), F.col("source").alias("translate"), F.expr(voice).alias("voice"))


def stage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored artifacts come from an earlier configuration: another voice for some, another language for labelled ones."""
    now = _items(spark, sf_dir, "case when doc_id % 4 = 0 then 'v1' else 'v2' end")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("item_id")).agg(F.max("quality").alias("quality"))
    old = _items(spark, sf_dir, "'v2'").join(labels, "item_id", "left").withColumn("translate", F.when(F.col("quality") == 1, F.lit("other")).otherwise(F.col("translate")))
    stored = media.wanted_stages(old, CONFIG)
    return media.plan_stages(now, stored, CONFIG).select("item_id", "stage_no", "stage", "signature", "cached")


def _signed(source: str, name: str) -> str:
    return f"""{name}1 as (select *, sha256('{{"source_size":' || source_size || ',"transcribe":"' || transcribe || '","upstream":""}}') as s1 from {source}),
{name}2 as (select *, sha256('{{"translate":"' || translate || '","upstream":"' || s1 || '"}}') as s2 from {name}1),
{name}3 as (select *, sha256('{{"voice":"' || voice || '","upstream":"' || s2 || '"}}') as s3 from {name}2),
{name} as (select item_id, 0 as stage_no, 'transcript' as stage, s1 as signature from {name}3 union all select item_id, 1, 'translation', s2 from {name}3 union all select item_id, 2, 'speech', s3 from {name}3)"""


QUERIES = {
    "stream_pick": (stream_pick, f"""with {STREAMS}, f as (select *, mime like 'video/%' and (width > 0 or height > 0) as pic, mime like 'audio/%' as aud, mime like 'video/%' and width <= 0 and height <= 0 as com from streams)
select video_id, coalesce(arg_min(idx, (-height, -bandwidth, idx)) filter (where pic and height <= 1080), arg_min(idx, (height, idx)) filter (where mime like 'video/%' and height > 0)) as video_idx,
arg_min(idx, (-bandwidth, idx)) filter (where aud) as audio_idx, arg_min(idx, (-bandwidth, idx)) filter (where com) as combined_idx from f group by video_id"""),
    "stream_links": (stream_links, """select l_orderkey, l_linenumber, 'https://cdn.example.com/' || l_partkey || case when l_suppkey <> l_partkey then ' https://cdn.example.com/' || l_suppkey else '' end as links from lineitem"""),
    "first_success": (first_success, """with t as (select l_orderkey as video_id, l_linenumber as ord, 'u' || l_partkey as url, l_returnflag = 'N' as ok, 'HTTP ' || l_suppkey as error from lineitem where l_linenumber <= 12),
w as (select video_id, min(ord) filter (where ok) as tries, arg_min(url, (ord, url)) filter (where ok) as url from t group by video_id)
select video_id, w.url, tries, coalesce(string_agg(error, ' | ' order by ord, error) filter (where not ok and (tries is null or ord < tries)), '') as failures from t join w using (video_id) group by all"""),
    "rendition_plan": (rendition_plan, """with s as (select p_partkey, 640 + 64 * (p_size % 20) as w, 360 + 40 * (p_partkey % 40) as h from part), t as (select * from s cross join (values ('16:9', 1920, 1080), ('3:4', 1080, 1440), ('9:16', 1080, 1920), ('1:1', 1080, 1080)) as a(aspect, tw, th)),
r as (select *, w / h::double as have, tw / th::double as want from t),
c as (select *, least(have, want) / greatest(have, want) as retention, cast(least(w, round_even(h * want, 0)) as int) as cw, cast(least(h, round_even(w / want, 0)) as int) as ch from r),
e as (select *, cw - cw % 2 as cw2, ch - ch % 2 as ch2, case when abs(have - want) <= 0.002 then 'copy' when retention >= 0.40 then 'crop' else 'blur_fill' end as action from c),
g as (select *, case when have > want then greatest(0, (w - cw2) // 2) else 0 end as x, case when have > want then 0 else greatest(0, (h - ch2) // 2) end as y from e)
select p_partkey, aspect, action, round(retention, 9) as retention, cast(case when action = 'crop' then case when have > want then cw2 else w - w % 2 end end as int) as crop_w, cast(case when action = 'crop' then case when have > want then h - h % 2 else ch2 end end as int) as crop_h,
cast(case when action = 'crop' then x - x % 2 end as int) as crop_x, cast(case when action = 'crop' then y - y % 2 end as int) as crop_y from g"""),
    "hash_assignment": (hash_assignment, """with b as (select p_brand, row_number() over (order by p_brand collate "C") - 1 as slot, count(*) over () as n from (select distinct p_brand from part)),
d as (select doc_id, source || '-' || doc_id as name, ('0x' || left(sha1(source || '-' || doc_id), 8))::bigint as bits from documents) select doc_id, name, p_brand from d join b on slot = bits % n"""),
    "stage_plan": (stage_plan, f"""with now0 as (select doc_id as item_id, n_chars as source_size, lang as transcribe, source as translate, case when doc_id % 4 = 0 then 'v1' else 'v2' end as voice from documents),
lab as (select doc_id, max(quality) as quality from labels group by doc_id),
old0 as (select d.doc_id as item_id, n_chars as source_size, lang as transcribe, case when quality = 1 then 'other' else source end as translate, 'v2' as voice from documents d left join lab on lab.doc_id = d.doc_id),
{_signed('now0', 'cur')}, {_signed('old0', 'old')} select c.item_id, c.stage_no, c.stage, c.signature, o.signature is not null as cached from cur c left join old o on o.item_id = c.item_id and o.stage = c.stage and o.signature = c.signature"""),
}
