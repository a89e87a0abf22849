"""Subtitle, batch and text queries over conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics.functions import regions, text
from clipmetrics.operators import batches, cues as ops
from clipmetrics.params import PackingParams
from clipmetrics.plans.adapters import CUES, PAIR_SCRIPT, PAIRS, SEGMENTS, cues, pairs, segments, table
from clipmetrics.session import work_dir
from clipmetrics.sources import subtitles as srt

PACKING = PackingParams(max_chars=700)


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.merge_intervals(cues(spark, sf_dir))
    return out.select("video_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "cues")


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.pack_speech(cues(spark, sf_dir), PACKING)
    return out.select("video_id", "first_ord", "start_s", F.round("end_s", 6).alias("end_s"), "cues", "text")


def long_text_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.split_long_texts(table(spark, sf_dir, "documents"), ["doc_id"], "text", 90)


def cue_segment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.match_cues(cues(spark, sf_dir), segments(spark, sf_dir)).select("video_id", "ord", "seg_id", F.round("shared", 6).alias("shared"))


def cue_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaped = segments(spark, sf_dir).withColumn("bbox", regions.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).withColumn(
        "placement", F.when(F.col("seg_id") % 4 == 0, "upper").when(F.col("seg_id") % 4 == 1, "bottom").otherwise(""))
    out = ops.place_cues(cues(spark, sf_dir), shaped)
    return out.select("video_id", "ord", "seg_id", "matched", "bottom", *[F.round(f"region.{k}", 6).alias(k) for k in "xywh"])


def _some_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).withColumn("text", F.when(F.col("ord") == 2, F.lit("  ")).otherwise(F.col("text")))


def srt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.srt_blocks(_some_blank(spark, sf_dir))


def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues written as subtitle files, many videos to an archive, and read again."""
    path = work_dir(spark, "srt")
    srt.write_subtitles(_some_blank(spark, sf_dir), path)
    back = srt.read_subtitles(spark, path)
    return back.select(F.col("video").cast("long").alias("video_id"), F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "text")


def _srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a subtitle file of its own with odd line ends, a numbered and an unnumbered block and a broken one."""
    c = cues(spark, sf_dir)
    line = F.concat(text.srt_time(F.col("start_s")), F.lit(" --> "), F.replace(text.srt_time(F.col("end_s")), F.lit(","), F.lit(".")))
    body = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    content = F.concat(F.lit("﻿1\r\n"), line, F.lit("\r\n"), body, F.lit("\r\n \r\n"), line, F.lit("\nsecond "), F.col("ord").cast("string"),
                       F.lit("\n\n3\nno time\ntext\n\n4\n00:00:05,000 --> 00:00:05,000\nempty span\n"))
    return c.select("video_id", "ord", content.alias("content"))


def srt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.parse_srt(_srt_files(spark, sf_dir), ["video_id", "ord"], joiner=" ").drop("block_no").withColumn("end_s", F.round("end_s", 6))


def srt_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files through the table function of SQL users."""
    srt.register_srt_function(spark)
    return spark.sql("select video_id, ord, s.start_s, round(s.end_s, 6) as end_s, s.text from {files}, lateral srt_cues(content) s", files=_srt_files(spark, sf_dir))


def srt_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    content = F.when(k == 0, F.lit("﻿ \r\n ")).when(k == 1, F.col("text")).when(k == 2, F.concat(F.lit("1\r\n00:00:01.000 --> 00:00:02,000\r"), F.col("text"))) \
        .otherwise(F.concat(F.lit("00:00:01,000 --> 00:00:02,000\n"), F.repeat("text", F.floor(F.lit(2_500_000) / F.greatest(F.lit(1), F.length("text"))).cast("int"))))
    return srt.validate_srt(d.select("doc_id", content.alias("content")), ["doc_id"])


def segment_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a metadata file: one segment with details, one without box, one without span."""
    s = segments(spark, sf_dir)
    shape = F.array("x", "y", "w", "h")
    none = F.array().cast("array<double>")
    entry = lambda start, end, b, details: F.struct(start.alias("start"), end.alias("end"), F.lit("t").alias("text"), b.alias("bbox"), details.alias("bboxRegions"), F.lit(" Bottom").alias("placement"))
    small = F.array(F.array(F.col("x"), F.col("y"), F.lit(0.001), F.col("h")))
    body = F.to_json(F.struct(F.array(entry(F.col("start_s"), F.col("end_s"), shape, small), entry(F.col("start_s"), F.col("end_s"), none, small),
                                      entry(F.col("end_s"), F.col("start_s"), shape, small)).alias("segments")))
    out = srt.segments_from_json(s.select("video_id", F.col("seg_id").alias("turn"), body.alias("body")), "body", ["video_id", "turn"])
    return out.select("video_id", "turn", "seg_id", "start_s", "end_s", *[F.round(f"bbox.{k}", 6).alias(k) for k in "xywh"], F.round(F.col("cleanup_regions")[0].w, 6).alias("cleanup_w"), "placement")


def context_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = PackingParams(batch_size=3, context=2)
    out = batches.context_batches(cues(spark, sf_dir), small)
    ids = lambda c: F.array_join(F.transform(c, lambda i: i.id.cast("string")), ",")
    return out.select("video_id", "batch_no", ids("items").alias("ids"), ids("before").alias("before_ids"), ids("after").alias("after_ids"),
                      F.array_join(F.transform("items", lambda i: i.text), " | ").alias("texts"))


def _stub(items: list[dict], context: dict) -> object:
    """Deterministic stand-in for a translator: fails on texts with 'thean', answers in several loose shapes."""
    if any("nt" in i["text"] and len(i["text"]) % 5 == 0 for i in items):
        raise ValueError("cannot translate")
    if len(items) == 1:
        return "» " + items[0]["text"]
    return {"translations": [{"id": i["id"], "vi": "» " + i["text"]} for i in items]}


def translate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = batches.context_batches(cues(spark, sf_dir), PackingParams(batch_size=4, context=1))
    return batches.with_bisection(made, _stub, batch_size=4)


def translation_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of single calls joined back; what was left out is listed as well."""
    made = batches.context_batches(cues(spark, sf_dir), PackingParams(batch_size=2, context=0))
    answers = batches.transform_batches(made, _stub)
    lines = cues(spark, sf_dir).withColumn("video_id", F.col("video_id").cast("string"))
    have, missing = batches.attach_translations(lines, answers)
    return have.select("video_id", "ord", "translation").unionByName(missing.select("video_id", "ord", F.lit(None).cast("string").alias("translation")))


def untranslated_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.untranslated(pairs(spark, sf_dir), PAIR_SCRIPT).select("id")


def untranslated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.bad_id_lists(pairs(spark, sf_dir), F.floor(F.col("id") / 10), PAIR_SCRIPT)


def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech text, squeezed observation text and counts of every document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.speech_text(F.concat(F.lit("\t"), "text", F.lit("​x"))).alias("speech"), text.squeeze(F.concat(F.lit(" ​"), "text")).alias("squeezed"),
                    text.script_count(F.col("text"), PAIR_SCRIPT).alias("script_chars"))


def file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and platform from file stems built of page paths."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 4
    stem = F.concat(F.lit(" "), F.replace("url", F.lit("/"), F.lit("_")), F.when(k == 0, F.concat(F.lit(" [BV1x"), F.col("page_id"), F.lit("] "))).when(k == 1, F.concat(F.lit("[av"), F.col("page_id"), F.lit("]"))).when(k == 2, " [Bilibili]").otherwise(" [123]"))
    rows = p.select("page_id", stem.alias("stem"))
    return rows.select("page_id", text.title_from_stem(F.col("stem")).alias("title"), text.platform_from_file(F.col("stem")).alias("platform"))


def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers in code fences, inside prose, plain or broken."""
    d = table(spark, sf_dir, "documents")
    body = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("text")))
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure: "), body, F.lit(" done"))).when(k == 2, body).otherwise(F.concat(F.lit("{"), F.col("source")))
    v = d.select("doc_id", text.lenient_json(raw).alias("v"))
    return v.select("doc_id", F.try_variant_get("v", "$.id", "bigint").alias("id"), F.try_variant_get("v", "$.text", "string").alias("text"))


SRT_TIME = """lpad(cast({0} // 3600000 as varchar), 2, '0') || ':' || lpad(cast({0} // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast({0} // 1000 % 60 as varchar), 2, '0') || ',' || lpad(cast({0} % 1000 as varchar), 3, '0')"""
MATCHED = f"""{CUES}, {SEGMENTS},
pairs as (select c.video_id, c.ord, s.seg_id, greatest(0, least(c.end_s, s.end_s) - greatest(c.start_s, s.start_s)) as shared, abs((c.start_s + c.end_s) / 2 - (s.start_s + s.end_s) / 2) as apart from cues c join segments s using (video_id)),
best as (select video_id, ord, coalesce(arg_min(seg_id, (-shared, seg_id)) filter (where shared > 0), arg_min(seg_id, (apart, seg_id)) filter (where apart <= 1.5)) as seg_id, max(shared) as shared,
  min(apart) <= 1.5 or max(shared) > 0 as near from pairs group by all),
matched as (select c.*, b.seg_id, case when b.near then b.shared end as shared from cues c left join best b using (video_id, ord))"""
# The greedy packing as a walk over the cues of a conversation.
PACKED = f"""with recursive {CUES}, n as (select *, trim(text) as t, row_number() over (partition by video_id order by start_s, ord) as rn from cues where trim(text) <> ''),
walk as (select video_id, rn, 1::bigint as chunk, start_s as cs, end_s as ce, length(t)::bigint as size from n where rn = 1
union all select n.video_id, n.rn, case when f then w.chunk else w.chunk + 1 end, case when f then w.cs else n.start_s end, n.end_s, case when f then w.size + 1 + length(n.t) else length(n.t) end
from walk w join n on n.video_id = w.video_id and n.rn = w.rn + 1, lateral (select w.size + 1 + length(n.t) <= 700 and n.end_s - w.cs <= 10.0 and n.start_s - w.ce <= 1.2 as f))
select cast(n.video_id as varchar) as video_id, min(n.ord) as first_ord, min(n.start_s) as start_s, round(arg_max(n.end_s, n.rn), 6) as end_s, count(*) as cues, string_agg(n.t, ' ' order by n.rn) as text
from walk join n using (video_id, rn) group by n.video_id, chunk"""
SPACED = "[\\s\\p{Z}]+"


def _packed_sql(pieces: str) -> str:
    """Greedy packing of a list: the last element is still open."""
    return f"""list_reduce(list_transform({pieces}, lambda p: [p]), lambda done, p: case when length(done[-1]) + 1 + length(p[1]) <= 90
  then list_concat(done[:-2], [done[-1] || ' ' || p[1]]) else list_concat(done, p) end)"""


SPLIT_SQL = f"""with c as (select doc_id, trim(regexp_replace(text, '{SPACED}', ' ', 'g')) as t from documents),
s as (select doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '([.!?。！？;；:：,，])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as sents from c where t <> ''),
p as (select doc_id, t, flatten(list_transform(sents, lambda x: case when length(x) <= 90 then [x] when not contains(x, ' ') then list_transform(range((length(x) - 1) // 90 + 1), lambda i: substr(x, i * 90 + 1, 90))
  else {_packed_sql("string_split(x, ' ')")} end)) as pieces from s),
r as (select doc_id, case when length(t) <= 90 then [t] else {_packed_sql('pieces')} end as parts from p)
select doc_id, cast(unnest(range(len(parts))) as int) as piece_no, unnest(parts) as piece from r"""

QUERIES = {
    "interval_merge": (interval_merge, f"""with {CUES}, r as (select *, max(end_s) over (partition by video_id order by start_s, ord rows between unbounded preceding and 1 preceding) as reach from cues),
g as (select *, sum(case when reach is null or start_s - reach > 0.30 then 1 else 0 end) over (partition by video_id order by start_s, ord) as part from r)
select video_id, round(min(start_s), 6) as start_s, round(max(end_s), 6) as end_s, count(*) as cues from g group by video_id, part"""),
    "chunk_pack": (chunk_pack, PACKED),
    "long_text_split": (long_text_split, SPLIT_SQL),
    "cue_segment_match": (cue_segment_match, f"with {MATCHED} select video_id, ord, seg_id, round(shared, 6) as shared from matched"),
    "cue_placement": (cue_placement, f"""with {MATCHED}, j as (select m.*, coalesce(s.x, 0.06::double) as x, coalesce(s.y, 0.72::double) as y, coalesce(s.w, 0.88::double) as w, coalesce(s.h, 0.18::double) as h from matched m left join segments s using (video_id, seg_id)),
b as (select *, case when seg_id % 4 = 0 then false when seg_id % 4 = 1 then true else y + h >= 0.68 end as bottom from j),
g as (select *, least(0.96::double, greatest(w, 0.24::double)) as tw, least(0.30::double, greatest(h, 0.05::double)) as th from b)
select video_id, ord, seg_id, seg_id is not null as matched, bottom, round(case when bottom then greatest(0.0, least(1.0 - tw, x + w / 2 - tw / 2)) else x end, 6) as x,
round(case when bottom then greatest(0.0, least(1.0 - th, y + h / 2 - th / 2)) else y end, 6) as y, round(case when bottom then tw else w end, 6) as w, round(case when bottom then th else h end, 6) as h from g"""),
    "srt_blocks": (srt_blocks, f"""with {CUES}, n as (select *, row_number() over (partition by video_id order by start_s, ord) as block_no, cast(round_even(start_s * 1000, 0) as bigint) as a, cast(round_even(end_s * 1000, 0) as bigint) as b from cues)
select video_id, block_no, block_no || chr(10) || {SRT_TIME.format('a')} || ' --> ' || {SRT_TIME.format('b')} || chr(10) || replace(trim(text), chr(10), ' ') || chr(10) as block from n where ord <> 2"""),
    "srt_files": (srt_files, f"""with {CUES} select video_id, round(cast(round_even(start_s * 1000, 0) as bigint) / 1000.0::double, 3) as start_s, round(cast(round_even(end_s * 1000, 0) as bigint) / 1000.0::double, 3) as end_s,
replace(trim(text), chr(10), ' ') as text from cues where ord <> 2"""),
    "srt_parse": (srt_parse, f"""with {CUES} select video_id, ord, start_s, round(end_s, 6) as end_s, replace(trim(text), chr(10), ' ') as text from cues where trim(text) <> ''
union all select video_id, ord, start_s, round(end_s, 6), 'second ' || ord from cues"""),
    "srt_table_function": (srt_table_function, f"""with {CUES} select video_id, ord, start_s, round(end_s, 6) as end_s, trim(text) as text from cues where trim(text) <> ''
union all select video_id, ord, start_s, round(end_s, 6), 'second ' || ord from cues"""),
    "srt_validate": (srt_validate, """select doc_id, doc_id % 4 = 2 as ok, case doc_id % 4 when 0 then 'subtitle cannot be empty' when 1 then 'no timing line found' when 3 then 'subtitle exceeds 2 MiB limit' end as reason from documents"""),
    "segment_metadata": (segment_metadata, f"""with {SEGMENTS} select video_id, seg_id as turn, 0 as seg_id, start_s, end_s, round(least(0.98::double, x), 6) as x, round(least(0.98::double, y), 6) as y, round(greatest(0.02, least(1.0 - x, w)), 6) as w,
round(greatest(0.02, least(1.0 - y, h)), 6) as h, 0.02::double as cleanup_w, 'bottom' as placement from segments"""),
    "context_batches": (context_batches, f"""with {CUES}, n as (select *, row_number() over (partition by video_id order by start_s, ord) - 1 as place from cues),
b as (select video_id, place // 3 as batch_no, string_agg(ord::varchar, ',' order by place) as ids, string_agg(trim(text), ' | ' order by place) as texts, min(place) as lo, max(place) as hi from n group by all)
select video_id, batch_no, ids, coalesce((select string_agg(ord::varchar, ',' order by place) from n where n.video_id = b.video_id and place between lo - 2 and lo - 1), '') as before_ids,
coalesce((select string_agg(ord::varchar, ',' order by place) from n where n.video_id = b.video_id and place between hi + 1 and hi + 2), '') as after_ids, texts from b"""),
    "translate_batches": (translate_batches, f"""with {CUES} select cast(video_id as varchar) as video_id, ord as id, case when not (contains(trim(text), 'nt') and length(trim(text)) % 5 = 0) then '» ' || trim(text) end as text,
case when contains(trim(text), 'nt') and length(trim(text)) % 5 = 0 then 'no translation' end as error from cues"""),
    "translation_attach": (translation_attach, f"""with {CUES}, n as (select *, (row_number() over (partition by video_id order by start_s, ord) - 1) // 2 as b, contains(trim(text), 'nt') and length(trim(text)) % 5 = 0 as bad from cues)
select cast(video_id as varchar) as video_id, ord, case when not bool_or(bad) over (partition by video_id, b) then '» ' || trim(text) end as translation from n"""),
    "untranslated_guard": (untranslated_guard, f"""with {PAIRS}, c as (select id, source_text as s, target_text as t, len(regexp_extract_all(source_text, '{PAIR_SCRIPT}')) as a, len(regexp_extract_all(target_text, '{PAIR_SCRIPT}')) as b,
len(regexp_extract_all(target_text, '\\p{{L}}')) as l from pairs) select id from c where a >= 3 and (regexp_replace(s, '{SPACED}', '', 'g') = regexp_replace(t, '{SPACED}', '', 'g') or (a >= 4 and b >= 4 and b / greatest(1, l)::double >= 0.55))"""),
    "untranslated_ids": (untranslated_ids, f"""with {PAIRS} select id // 10 as batch, count(*) as n_bad, string_agg(id::varchar, ',' order by id) as bad_ids from pairs
where len(regexp_extract_all(source_text, '{PAIR_SCRIPT}')) >= 3 and (regexp_replace(source_text, '{SPACED}', '', 'g') = regexp_replace(target_text, '{SPACED}', '', 'g')
or (len(regexp_extract_all(source_text, '{PAIR_SCRIPT}')) >= 4 and len(regexp_extract_all(target_text, '{PAIR_SCRIPT}')) >= 4 and len(regexp_extract_all(target_text, '{PAIR_SCRIPT}')) / greatest(1, len(regexp_extract_all(target_text, '\\p{{L}}')))::double >= 0.55)) group by 1"""),
    "text_cleaning": (text_cleaning, f"""select doc_id, trim(regexp_replace(text || ' x', '{SPACED}', ' ', 'g')) as speech, regexp_replace(regexp_replace(text, '{SPACED}', '', 'g'), '[\\x{{200b}}-\\x{{200f}}\\x{{feff}}]', '', 'g') as squeezed,
len(regexp_extract_all(text, '{PAIR_SCRIPT}')) as script_chars from documents"""),
    "file_titles": (file_titles, """with f as (select page_id, replace(url, '/', '_') as u, page_id % 4 as k from pages)
select page_id, left(case when k < 2 then trim(replace(u, '_', ' ')) else replace(u, '_', ' ') || case k when 2 then ' [Bilibili]' else ' [123]' end end, 240) as title, case when k in (0, 2) then 'bilibili' else '' end as platform from f"""),
    "lenient_json": (lenient_json, "select doc_id, case when doc_id % 4 <> 3 then doc_id end as id, case when doc_id % 4 <> 3 then text end as text from documents"),
}
