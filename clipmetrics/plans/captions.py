"""Caption queries over the event log read as timed text observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics.functions import regions, similarity
from clipmetrics.operators import boxes, captions
from clipmetrics.params import CaptionParams, PersistentParams
from clipmetrics.plans.adapters import OBSERVATIONS, observations, table, with_boxes
from clipmetrics.session import written

# Events are hours apart, so an interval of an hour and a gap of a day take the place of frames.
HOURLY = CaptionParams(interval=3600.0, max_gap=86_400.0, min_confidence=0.10, persistent_seconds=200_000.0, slice_seconds=604_800.0)
RECOVERY = CaptionParams(interval=3600.0, max_gap=86_400.0, min_confidence=0.58, persistent_seconds=0.0, slice_seconds=604_800.0)
FRAME_W, FRAME_H = 1080.0, 1920.0


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the same text differ: some with a trailing s, some with an exclamation mark."""
    tail = F.element_at(F.array(F.lit(""), F.lit("s"), F.lit("!")), (F.col("ord") % 3 + 1).cast("int"))
    return observations(spark, sf_dir).withColumn("text", F.concat("text", tail))


def caption_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = captions.accept(observations(spark, sf_dir), HOURLY)
    out = captions.not_persistent(captions.equal_text_segments(accepted, HOURLY), HOURLY)
    return out.withColumn("confidence", F.round("confidence", 6))


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = captions.accept(_noisy(spark, sf_dir), HOURLY)
    return captions.finalize(captions.similar_text_segments(accepted, HOURLY), HOURLY)


FINAL = ["video_id", "seg_id", "start_s", "end_s", "text", "confidence", "consensus_score", "observation_count", "winner_count", "representative_ord"]


def caption_segments_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir).select(*FINAL)


def caption_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = captions.with_geometry(_final(spark, sf_dir), with_boxes(observations(spark, sf_dir)))
    return out.select("video_id", "seg_id", *[F.col(f"bbox.{k}").alias(k) for k in "xywh"], F.size("regions").alias("n_regions"),
                      F.col("regions")[0].x.alias("detail_x"), F.col("regions")[0].h.alias("detail_h"), "placement")


def _daily(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.floor(F.col("t") / 86_400))


def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = captions.exact_text_vote(_daily(observations(spark, sf_dir)), ["video_id", "day"])
    return voted.withColumns({c: F.round(c, 6) for c in ("confidence", "consensus_score")})


def consensus_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = captions.consensus(_daily(_noisy(spark, sf_dir)), ["video_id", "day"], HOURLY)
    return voted.drop("winners").withColumns({c: F.round(c, 6) for c in ("confidence", "consensus_score")})


def consensus_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote as an SQL function over the gathered observations of a user's days, which are many and small."""
    captions.register_consensus(spark)
    return spark.sql("select video_id, day, consensus_text_of(collect_list(struct(text, confidence, ord))) as text from {daily} group by video_id, day", daily=_daily(_noisy(spark, sf_dir)))


def _same_start(a: str, b: str) -> float:
    """A similarity of one's own: texts are alike when they begin alike."""
    return float(bool(a) and a[:4] == b[:4])


def caption_segments_own_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = captions.accept(_noisy(spark, sf_dir), HOURLY)
    out = captions.finalize(captions.similar_text_segments(accepted, HOURLY, _same_start), HOURLY, _same_start)
    return out.select(*FINAL)


def refine_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain segments of every video with the times at which to look again."""
    doubtful = captions.to_refine(_final(spark, sf_dir), HOURLY)
    times = captions.sample_times(F.col("start_s"), F.col("end_s"), HOURLY.refine_samples)
    return doubtful.select("video_id", "seg_id", F.posexplode(times).alias("sample", "at")).withColumn("at", F.round("at", 3))


def caption_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refined segments with the geometry of the finer observation that stands for them."""
    fine = with_boxes(observations(spark, sf_dir))
    out = captions.with_geometry(captions.refine(_final(spark, sf_dir), fine, HOURLY), fine, fine=fine)
    return out.select(*FINAL, "refined", *[F.col(f"bbox.{k}").alias(k) for k in "xywh"])


def caption_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to clean in each final segment: the envelopes of the boxes of its winning observations."""
    numbered = captions.similar_text_segments(captions.accept(with_boxes(_noisy(spark, sf_dir)), HOURLY), HOURLY)
    return captions.cleanup_of_winners(captions.finalize(numbered, HOURLY), numbered)


def caption_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day is a video, so that many have only doubtful observations."""
    segment = lambda df, p: captions.not_persistent(captions.equal_text_segments(df, p), p)
    days = _daily(observations(spark, sf_dir)).withColumn("video_id", F.concat("video_id", F.lit("/"), F.col("day")))
    out = captions.recover_empty(days, segment, RECOVERY)
    return out.select("video_id", "start_s", "end_s", "text", "observation_count")


def cleanup_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _daily(observations(spark, sf_dir)).select("video_id", "day", F.col("ord").alias("item"), "x", "y", "w", "h")
    return boxes.cleanup_regions(items, ["video_id", "day"])


def detection_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _daily(observations(spark, sf_dir))
    frames = obs.groupBy("video_id", "text").agg(F.count_distinct("day").alias("frame_count"))
    items = obs.select("video_id", "text", F.col("ord").alias("item"), "x", "y", "w", "h")
    out = boxes.cluster_detections(items, frames, ["video_id", "text"])
    return out.select("video_id", "text", "cluster", "hits", F.round("confidence", 6).alias("confidence"), *[F.round(f"box.{k}", 6).alias(k) for k in "xywh"])


def _keyed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("video_id", "text", "x", "y", "w", "h")


def box_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.envelope(_keyed_boxes(spark, sf_dir), ["video_id", "text"]).select("video_id", "text", *[F.round(k, 6).alias(k) for k in "xywh"])


def _flat(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(f"box.{k}", 6).alias(k) for k in "xywh"])


def robust_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(boxes.robust_box(_keyed_boxes(spark, sf_dir), ["video_id", "text"]), ["video_id", "text"])


def region_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(boxes.text_region(_keyed_boxes(spark, sf_dir), ["video_id"]), ["video_id"])


def region_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge quantiles of every event kind from sketches kept per day, each with whether its true rank is within 1 % of the wanted one."""
    obs = _daily(observations(spark, sf_dir)).select("text", "day", "x", "y", "w", "h")
    stored = written(boxes.edge_sketches(obs, ["text", "day"], unit="day"), "edge-sketches")
    q = boxes.sketched_quantiles(boxes.merge_sketches(stored, ["text"]), ["text"], 0.05, 0.95)
    seen = obs.join(q, "text").groupBy("text").agg(
        F.max("boxes").alias("boxes"), F.max("units").alias("days"),
        *[((F.avg((edge < F.col(n)).cast("double")) <= at + 0.01) & (F.avg((edge <= F.col(n)).cast("double")) >= at - 0.01)).alias(f"{n}_near")
          for n, edge, at in zip("ltrb", boxes.edges(), (0.05, 0.05, 0.95, 0.95))])
    return seen


def region_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.side(_keyed_boxes(spark, sf_dir), ["video_id", "text"])


def detail_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three boxes per observation, one of them often too small, as details in reading order."""
    obs = observations(spark, sf_dir)
    trio = F.array(regions.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")), regions.box(F.col("y"), F.col("x"), F.col("w"), (F.col("ord") % 4) / 1000.0),
                   regions.box(F.col("x") / 2, F.col("y") / 2, F.col("h"), F.col("w")))
    return obs.select("ord", F.posexplode(regions.detail_boxes(trio)).alias("pos", "b")).select("ord", "pos", *[F.col(f"b.{k}").alias(k) for k in "xywh"])


def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit-distance similarity of part names and types."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(similarity.similarity(F.lower("p_name"), F.lower(F.concat("p_type", F.lit(" "), "p_brand"))), 9).alias("similarity"))


def text_similarity_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching-blocks similarity of the same texts."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(similarity.similarity(F.lower("p_name"), F.lower(F.concat("p_type", F.lit(" "), "p_brand")), mode="exact"), 9).alias("similarity"))


def consensus_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of one size as readings of one text: many distinct ones in few segments."""
    p = table(spark, sf_dir, "part")
    seen = p.select(F.col("p_size").alias("size"), F.col("p_partkey").alias("ord"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"),
                    ((F.col("p_partkey") % 499) / 499.0).alias("confidence"))
    voted = captions.consensus(seen, ["size"])
    return voted.select("size", "text", F.round("confidence", 6).alias("confidence"), F.round("consensus_score", 6).alias("consensus_score"),
                        "observation_count", "winner_count", "representative_ord")


BRAND = PersistentParams(brand="purchase")


def _sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return obs.withColumn("sample", F.floor(F.col("t") / 86_400)).withColumn("side", F.when(F.col("x") + F.col("w") / 2 < 0.35, "left").when(F.col("x") + F.col("w") / 2 > 0.5, " Right").otherwise("middle"))


def persistent_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    sided = _sided(spark, sf_dir)
    samples = sided.groupBy("video_id").agg(F.count_distinct("sample").alias("sample_count"))
    out = boxes.persistent_region(sided, samples, BRAND)
    return out.select("video_id", "side", "hits", "confidence", *[F.col(f"region.{k}").alias(k) for k in "xywh"])


def persistent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sided = _sided(spark, sf_dir)
    samples = sided.groupBy("video_id").agg(F.count_distinct("sample").alias("sample_count"))
    out = boxes.persistent_texts(sided, boxes.persistent_region(sided, samples, BRAND), BRAND)
    return out.select("video_id", F.array_join("texts", ",").alias("texts"))


def caption_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as videos, all their boxes as protected regions (those of errors as faces), the last one as their own subtitle."""
    obs = observations(spark, sf_dir)
    kind = F.when(F.col("text") == "error", "face").otherwise("logo")
    protected = obs.select("video_id", kind.alias("kind"), "x", "y", "w", "h")
    last = F.max_by(F.struct(F.struct("x", "y", "w", "h").alias("b"), F.col("confidence")), "ord")
    videos = obs.groupBy("video_id").agg(last.alias("v"), F.max("ord").alias("o")).select(
        "video_id", F.lit(1080).alias("width"), F.when(F.col("o") % 2 == 0, 1920).otherwise(608).alias("height"),
        F.col("v.b").alias("source_region"), F.col("v.confidence").alias("source_confidence"))
    return boxes.place_captions(videos, protected)


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = lambda c, size: F.round(F.col(c) * size)
    return _daily(observations(spark, sf_dir)).select(
        "video_id", F.col("day").alias("frame"), F.col("ord").alias("det"), px("x", FRAME_W).alias("x"), px("y", FRAME_H).alias("y"),
        px("w", FRAME_W).alias("w"), px("h", FRAME_H).alias("h"), "text", "confidence")


def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.caption_lines(_detections(spark, sf_dir), FRAME_W, FRAME_H).select("video_id", "frame", "det", "line", "text")


def frame_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = captions.frame_texts(_detections(spark, sf_dir), FRAME_W, FRAME_H)
    return out.select("video_id", "frame", "text", F.round("confidence", 6).alias("confidence"), F.size("boxes").alias("n_boxes"),
                      F.round(F.col("boxes")[0].x, 6).alias("x0"), F.round(F.col("boxes")[0].h, 6).alias("h0"))


def islands(source: str, text: str, min_conf: str) -> str:
    return f"""acc as (select *, {text} as base from {source} where confidence >= {min_conf}),
lagged as (select *, lag(t) over w as pt, lag(base) over w as pb from acc window w as (partition by video_id order by t, ord)),
seg as (select *, sum(case when pt is null or t - pt > 86400 or base <> pb then 1 else 0 end) over (partition by video_id order by t, ord rows unbounded preceding) as seg_no from lagged)"""


# One noisy reading per observation; readings of one event type resemble each other and no other type.
NOISY = OBSERVATIONS + """, noisy as (select * exclude (text), text as kind, text || ['', 's', '!'][ord % 3 + 1] as text, text || case when ord % 3 = 1 then 's' else '' end as cmp from observations)"""


def _voted(source: str, keys: str) -> str:
    return f"""texts as (select {keys}, kind, cmp, count(*) as n, sum(confidence) as total, min(ord) as first_ord, max(confidence) as best, arg_min(ord, (-confidence, ord)) as best_ord, arg_min(text, (-confidence, ord)) as best_text from {source} group by {keys}, kind, cmp),
clusters as (select {keys}, kind, sum(n) as size, sum(total) as weight, min(first_ord) as first_ord from texts group by {keys}, kind),
usable as (select {keys}, sum(n) as n_all from texts group by {keys}),
win as (select * from (select *, row_number() over (partition by {keys} order by size desc, weight desc, first_ord) as k from clusters) where k = 1),
standing as (select t.*, w.size, w.weight, case when w.size > 1 then ((t.n - 1) + (w.size - t.n) * (2.0::double * length(t.kind) / (2 * length(t.kind) + 1))) / (w.size - 1)::double else 1.0::double end * 0.82::double + t.best * 0.18::double as rank
  from texts t join win w using ({keys}, kind)),
voted as (select {keys}, best_text as text, weight / size as confidence, size / n_all::double as consensus_score, cast(n_all as bigint) as observation_count, cast(size as bigint) as winner_count, best_ord as representative_ord
  from (select *, row_number() over (partition by {keys} order by round(rank, 9) desc, best_ord) as k from standing) join usable using ({keys}) where k = 1)"""


FINAL_SQL = f"""{NOISY}, {islands('noisy', 'kind', '0.10')},
spans as (select video_id, seg_no, min(t) as start_s, max(t) + 3600 as end_s from seg group by all), {_voted('seg', 'video_id, seg_no')},
kept as (select * from spans join voted using (video_id, seg_no) where end_s - start_s >= 0.35 and not (end_s - start_s >= 200000 and observation_count >= 4)),
final as (select video_id, row_number() over (partition by video_id order by start_s, seg_no) - 1 as seg_id, start_s, end_s, text, round_even(confidence, 4) as confidence, round_even(consensus_score, 4) as consensus_score,
  observation_count, winner_count, representative_ord from kept)"""
DAILY = "daily as (select *, cast(floor(t / 86400) as bigint) as day from {})"
PX = "px as (select video_id, cast(floor(t / 86400) as bigint) as frame, ord as det, round(x * 1080) as x, round(y * 1920) as y, round(w * 1080) as w, round(h * 1920) as h, text, confidence from observations)"


def _pad(x: str, w: str, pad: float, low: float) -> tuple[str, str]:
    left = f"greatest(0.0::double, least({1.0 - low}::double, {x} - {pad}::double))"
    right = f"greatest({left} + {low}::double, least(1.0::double, {x} + {w} + {pad}::double))"
    return left, f"({right} - {left})"


def _quantile_sql(low: float, high: float, min_w: float, min_h: float, px: float, py: float, keys: str) -> str:
    x, w = _pad("l", f"greatest({min_w}::double, r - l)", px, 0.01)
    y, h = _pad("tp", f"greatest({min_h}::double, b - tp)", py, 0.01)
    return f"""with {OBSERVATIONS}, q as (select {keys}, quantile_cont((x)::double, {low}) as l, quantile_cont((y)::double, {low}) as tp,
quantile_cont((x)::double + w, {high}) as r, quantile_cont((y)::double + h, {high}) as b from observations group by {keys})
select {keys}, round({x}, 6) as x, round({y}, 6) as y, round({w}, 6) as w, round({h}, 6) as h from q"""


_GX, _GW = _pad("x", "greatest(0.001::double, x + w - x)", 0.012, 0.005)
_GY, _GH = _pad("y", "greatest(0.001::double, y + h - y)", 0.008, 0.005)
_DX, _ = _pad("x", "w", 0.004, 0.005)
_, _DH = _pad("y", "h", 0.004, 0.005)


def _zone_cost(i: int) -> str:
    x, tall, wide = boxes.ZONES[i]
    y = f"(case when height >= width then {tall}::double else {wide}::double end)"
    w = f"(least(x + w, {x}::double + 0.84::double) - greatest(x, {x}::double))"
    h = f"(least(y + h, {y} + 0.15::double) - greatest(y, {y}))"
    return f"coalesce(sum(case when {w} > 0 and {h} > 0 then {w} * {h} / greatest(1e-6, least(w * h, 0.84::double * 0.15::double)) * f else 0 end), 0) + {i} * 0.018::double as c{i}"


def _placement_sql() -> str:
    anchors = " ".join(f"when {i} then (case when height >= width then {t}::double else {w}::double end) + 0.15::double * 0.58::double" for i, (_, t, w) in enumerate(boxes.ZONES))
    return f"""with {OBSERVATIONS}, v as (select video_id, 1080 as width, case when max(ord) % 2 = 0 then 1920 else 608 end as height, arg_max(y, ord) as sy, arg_max(h, ord) as sh, arg_max(confidence, ord) as sc from observations group by video_id),
p as (select video_id, case when text = 'error' then 1.8::double else 1.0::double end as f, x::double as x, y::double as y, w::double as w, h::double as h from observations),
c as (select video_id, width, height, sy, sh, sc, {', '.join(_zone_cost(i) for i in range(4))} from v left join p using (video_id) group by all),
z as (select *, case least(c0, c1, c2, c3) when c0 then 0 when c1 then 1 when c2 then 2 else 3 end as best from c)
select video_id, case when sc >= 0.68 then 'replace_source_subtitle' else 'lowest_safe_zone' end as reason, case when sc < 0.68 then best end as zone,
round(case when sc >= 0.68 then greatest(0.12::double, least(0.90::double, sy + sh * 0.56::double)) else case best {anchors} end end, 5) as anchor_y from z"""


SIDED = """sided as (select *, cast(floor(t / 86400) as bigint) as sample, case when x + w / 2 < 0.35 then 'left' when x + w / 2 > 0.5 then 'right' else 'middle' end as side from
(select * replace (x::double as x, y::double as y, w::double as w, h::double as h) from observations))"""
PERSISTENT_SQL = f"""with {OBSERVATIONS}, {SIDED},
s as (select *, cast(trunc((x + w / 2) / 0.07::double) as int) as cx, cast(trunc((y + h / 2) / 0.045::double) as int) as cy, least(1.0, confidence) + 0.25::double + case when contains(lower(text), 'purchase') then 2.75::double else 0 end as pts from sided where side <> 'middle'),
counts as (select video_id, count(distinct sample) as sample_count from sided group by video_id),
cl as (select video_id, side, cx, cy, count(distinct sample) as hits, sum(pts) as score, bool_or(contains(lower(text), 'purchase')) as brand, min(x) as l, min(y) as tp, max(x + w) as r, max(y + h) as b from s group by all),
per as (select * from cl join counts using (video_id) where hits >= 2 or brand),
sides as (select video_id, side, sum(score * (1.0 + hits / sample_count::double)) as gain, min(l) as l, min(tp) as tp, max(r) as r, max(b) as b, any_value(sample_count) as sample_count from per group by video_id, side),
ch as (select *, sum(gain) over (partition by video_id) as all_gain, row_number() over (partition by video_id order by gain desc, side) as k from sides),
hit as (select s.video_id, s.side, count(distinct s.sample) as hits from s semi join per p on p.video_id = s.video_id and p.side = s.side and p.cx = s.cx and p.cy = s.cy group by all),
g as (select *, greatest(0.14::double, least(0.40::double, greatest(r - l + 2 * 0.018::double, 0.14::double))) as tw, greatest(0.045::double, least(0.16::double, greatest(b - tp + 2 * 0.012::double, 0.045::double))) as th from ch join hit using (video_id, side) where k = 1)
select video_id, side, hits, round_even(greatest(0.0, least(1.0, 0.55::double * hits / sample_count + 0.45::double * gain / greatest(0.001::double, all_gain))), 4) as confidence,
round_even(greatest(0.0, least(1.0 - tw, l + (r - l) / 2 - tw / 2)), 6) as x, round_even(greatest(0.0, least(1.0 - th, tp + (b - tp) / 2 - th / 2)), 6) as y, round_even(tw, 6) as w, round_even(th, 6) as h from g"""



def _grouped_sql(keys: str, hit: str, floor: str) -> str:
    """Greedy grouping of boxes as a walk: each joins the first group one of whose boxes it overlaps enough."""
    on = " and ".join(f"n.{k} = w.{k}" for k in keys.split(", "))
    lead = ", ".join(f"n.{k}" for k in keys.split(", "))
    cut = "(least(b.x + b.w, n.x + n.w) - greatest(b.x, n.x))", "(least(b.y + b.h, n.y + n.h) - greatest(b.y, n.y))"
    share = f"case when {cut[0]} > 0 and {cut[1]} > 0 then {cut[0]} * {cut[1]} / greatest({floor}, least(b.w * b.h, n.w * n.h)) else 0 end"
    box = "{{'x': n.x, 'y': n.y, 'w': n.w, 'h': n.h, 'grp': {}}}"
    group = f"coalesce(list_min(list_transform(list_filter(w.boxes, lambda b: {share} {hit}), lambda b: b.grp)), list_max(list_transform(w.boxes, lambda b: b.grp)) + 1)"
    return f"""numbered as (select {keys}, x::double as x, y::double as y, w::double as w, h::double as h, row_number() over (partition by {keys} order by ord) as rn, count(*) over (partition by {keys}) as total from daily where w > 0.001 and h > 0.001),
walk as (select {lead}, rn, total, [{box.format(0)}] as boxes from numbered n where rn = 1
union all select {lead}, n.rn, n.total, list_append(w.boxes, {box.format(group)}) from walk w join numbered n on {on} and n.rn = w.rn + 1),
members as (select {keys}, unnest(boxes) as b from walk where rn = total)"""


CLEANUP_SQL = f"""with recursive {OBSERVATIONS}, {DAILY.format('observations')}, {_grouped_sql('video_id, day', '>= 0.28', '1e-9')},
env as (select video_id, day, b.grp as grp, greatest(0.0, min(b.x) - 0.010::double) as x, greatest(0.0, min(b.y) - 0.008::double) as y, least(1.0, max(b.x + b.w) + 0.010::double) as r, least(1.0, max(b.y + b.h) + 0.008::double) as bt from members group by all),
k as (select *, row_number() over (partition by video_id, day order by y, x, grp) as region_no from env)
select video_id, day, cast(region_no as int) as region_no, round_even(x, 6) as x, round_even(y, 6) as y, round_even(greatest(0.001, r - x), 6) as w, round_even(greatest(0.001, bt - y), 6) as h from k where region_no <= 10"""
_CX, _CW = _pad("l", "(r - l)", 0.025, 0.01)
_CY, _CH = _pad("tp", "(bt - tp)", 0.025, 0.01)
CLUSTER_SQL = f"""with recursive {OBSERVATIONS}, {DAILY.format('observations')}, {_grouped_sql('video_id, text', '> 0.25', '1e-6')},
frames as (select video_id, text, count(distinct day) as frame_count from daily group by all),
g as (select video_id, text, b.grp as grp, count(*) as hits, quantile_cont(b.x, 0.5) as l, quantile_cont(b.y, 0.5) as tp, quantile_cont(b.x + b.w, 0.5) as r, quantile_cont(b.y + b.h, 0.5) as bt from members group by all),
k as (select *, row_number() over (partition by video_id, text order by grp) as cluster from g join frames using (video_id, text) where hits >= greatest(2, frame_count // 5))
select video_id, text, cast(cluster as int) as cluster, hits, round(least(0.98::double, 0.55::double + hits / greatest(1, frame_count)::double * 0.35::double), 6) as confidence,
round({_CX}, 6) as x, round({_CY}, 6) as y, round({_CW}, 6) as w, round({_CH}, 6) as h from k where cluster <= 3"""

# Lines of a frame as a walk over its detections; the rest is the score of single lines and neighbouring pairs.
_RANK = """1.55::double * {0}conf / {0}n + 0.75::double * least(1.0, greatest(0.0, {0}r - {0}l) / 1080.0 / 0.55::double) + 0.35::double * greatest(0.0, 1.0 - abs(({0}l + {0}r) / 2.0 / 1080.0 - 0.5::double) * 2.0)
  + 0.55::double * least(1.0, {0}chars / 18.0::double) + 0.15::double * (({0}t + {0}b) / 2.0 / 1920.0)"""
LINES_SQL = f"""with recursive {OBSERVATIONS}, {PX}, n as (select *, y + h / 2 as middle, row_number() over (partition by video_id, frame order by y, x, det) as rn from px),
walk as (select video_id, frame, rn, 1::bigint as line, [{{'s': middle, 'n': 1}}] as lines from n where rn = 1
union all select n.video_id, n.frame, n.rn, hit, case when hit <= len(w.lines) then list_transform(w.lines, lambda li, i: case when i = hit then {{'s': li.s + n.middle, 'n': li.n + 1}} else li end) else list_append(w.lines, {{'s': n.middle, 'n': 1}}) end
from walk w join n on n.video_id = w.video_id and n.frame = w.frame and n.rn = w.rn + 1,
lateral (select coalesce(nullif(list_position(list_transform(w.lines, lambda li: abs(n.middle - li.s / li.n) <= 86.4::double), true), 0), len(w.lines) + 1)::bigint as hit)),
tagged as (select n.*, line - 1 as line from n join walk using (video_id, frame, rn)),
parts as (select video_id, frame, line, min(x) as l, max(x + w) as r, min(y) as t, max(y + h) as b, sum(confidence) as conf, count(*) as n, sum(length(text)) as chars from tagged group by all),
ahead as (select *, lead(l) over v as l2, lead(r) over v as r2, lead(t) over v as t2, lead(b) over v as b2, lead(conf) over v as c2, lead(n) over v as n2, lead(chars) over v as ch2 from parts window v as (partition by video_id, frame order by line)),
single as (select video_id, frame, line, 0 as pair, {_RANK.format('')} as score from ahead),
pairs as (select video_id, frame, line, least(l, l2) as l, greatest(r, r2) as r, least(t, t2) as t, greatest(b, b2) as b, conf + c2 as conf, n + n2 as n, chars + ch2 as chars from ahead where l2 is not null and abs((t + b) / 2 - (t2 + b2) / 2) / 1920.0 <= 0.15),
every as (select * from single union all select video_id, frame, line, 1, {_RANK.format('')} from pairs),
best as (select video_id, frame, line as first, pair from (select *, row_number() over (partition by video_id, frame order by score desc, line, pair) as k from every) where k = 1)
select video_id, frame, det, line, text from tagged join best using (video_id, frame) where line between first and first + pair"""

# The finer observations are plain readings: equal texts agree fully, different types never join.
REFINE_SQL = f"""with {FINAL_SQL}, d as (select *, row_number() over (partition by video_id order by seg_id) as k from final where confidence < 0.72 or consensus_score < 0.67 or observation_count < 2),
s as (select video_id, seg_id, sample, start_s + (end_s - start_s) * ratio as moment from d cross join (values (0, 0.22::double), (1, 0.50::double), (2, 0.78::double)) as v(sample, ratio) where k <= 16),
near as (select s.video_id, seg_id, sample, arg_min(o.text, (abs(o.t - moment), o.ord)) as text, arg_min(o.confidence, (abs(o.t - moment), o.ord)) as confidence, arg_min(o.ord, (abs(o.t - moment), o.ord)) as o_ord from s join observations o on o.video_id = s.video_id and abs(o.t - moment) <= 1800 and o.confidence >= 0.5 group by all),
grp as (select video_id, seg_id, text, count(*) as n, sum(confidence) as total, min(sample) as first_s, arg_min(o_ord, (-confidence, sample)) as o_ord from near group by all),
fine_win as (select *, row_number() over (partition by video_id, seg_id order by n desc, total desc, first_s) as k, sum(n) over (partition by video_id, seg_id) as n_all from grp),
new as (select video_id, seg_id, text as n_text, total / n as n_conf, n / n_all::double as n_score, cast(n_all as bigint) as n_obs, n as n_win, o_ord from fine_win where k = 1),
j as (select f.*, new.* exclude (video_id, seg_id), coalesce(n_win >= 2 or n_conf >= confidence + 0.05 or n_score >= 0.80, false) as take from final f left join new using (video_id, seg_id))
select j.video_id, seg_id, start_s, end_s, case when take then n_text else text end as text, case when take then round_even(n_conf, 4) else confidence end as confidence, case when take then round_even(n_score, 4) else consensus_score end as consensus_score,
case when take then n_obs else observation_count end as observation_count, case when take then n_win else winner_count end as winner_count, j.representative_ord, take as refined,
round_even({_GX}, 6) as x, round_even({_GY}, 6) as y, round_even({_GW}, 6) as w, round_even({_GH}, 6) as h
from j join (select video_id, ord as shown, x::double as x, y::double as y, w::double as w, h::double as h from observations) b on b.video_id = j.video_id and b.shown = case when take then o_ord else j.representative_ord end"""

QUERIES = {
    "caption_segments": (caption_segments, f"""with {OBSERVATIONS}, {islands('observations', 'text', '0.10')},
g as (select video_id, seg_no, min(t) as start_s, max(t) + 3600 as end_s, arg_min(text, (-confidence, ord)) as text, round(avg(confidence), 6) as confidence, count(*) as observation_count from seg group by all)
select * from g where end_s - start_s >= 0.35 and not (end_s - start_s >= 200000 and observation_count >= 4)"""),
    "caption_segments_similar": (caption_segments_similar, f"with {FINAL_SQL} select {', '.join(FINAL)} from final"),
    "consensus_sql": (consensus_sql, f"""with {NOISY}, {DAILY.format('noisy')}, {_voted('daily', 'video_id, day')} select video_id, day, text from voted"""),
    "caption_segments_own_ratio": (caption_segments_own_ratio, f"with {FINAL_SQL} select {', '.join(FINAL)} from final".replace("(2.0::double * length(t.kind) / (2 * length(t.kind) + 1))", "1.0::double")),
    "caption_geometry": (caption_geometry, f"""with {FINAL_SQL}, b as (select video_id, ord as representative_ord, x::double as x, y::double as y, w::double as w, h::double as h from observations)
select video_id, seg_id, round_even({_GX}, 6) as x, round_even({_GY}, 6) as y, round_even({_GW}, 6) as w, round_even({_GH}, 6) as h, 1 as n_regions, round_even({_DX}, 6) as detail_x, round_even({_DH}, 6) as detail_h,
case when {_GY} + {_GH} >= 0.68 then 'bottom' else 'upper' end as placement from final join b using (video_id, representative_ord)"""),
    "consensus_vote": (consensus_vote, f"""with {OBSERVATIONS}, {DAILY.format('observations')}, p as (select video_id, day, text, count(*) as n, sum(confidence) as total from daily group by all),
r as (select *, row_number() over (partition by video_id, day order by n desc, total desc, text desc) as k, sum(n) over (partition by video_id, day) as n_all from p)
select video_id, day, text, round(total / n, 6) as confidence, round(n / n_all::double, 6) as consensus_score, cast(n_all as bigint) as observation_count, n as winner_count from r where k = 1"""),
    "consensus_similar": (consensus_similar, f"""with {NOISY}, {DAILY.format('noisy')}, {_voted('daily', 'video_id, day')}
select video_id, day, text, round(confidence, 6) as confidence, round(consensus_score, 6) as consensus_score, observation_count, winner_count, representative_ord from voted"""),
    "refine_candidates": (refine_candidates, f"""with {FINAL_SQL}, d as (select *, row_number() over (partition by video_id order by seg_id) as k from final where confidence < 0.72 or consensus_score < 0.67 or observation_count < 2)
select video_id, seg_id, sample, round(start_s + (end_s - start_s) * ratio, 3) as at from d cross join (values (0, 0.22::double), (1, 0.50::double), (2, 0.78::double)) as s(sample, ratio) where k <= 16"""),
    "caption_refine": (caption_refine, REFINE_SQL),
    "caption_cleanup": (caption_cleanup, f"""with recursive {FINAL_SQL}, fin as (select video_id, seg_no, row_number() over (partition by video_id order by start_s, seg_no) - 1 as seg_id from kept),
daily as (select video_id, seg_id, ord, x, y, w, h from seg join win using (video_id, seg_no, kind) join fin using (video_id, seg_no)), {_grouped_sql('video_id, seg_id', '>= 0.28', '1e-9')},
env as (select video_id, seg_id, b.grp as grp, greatest(0.0, min(b.x) - 0.010::double) as x, greatest(0.0, min(b.y) - 0.008::double) as y, least(1.0, max(b.x + b.w) + 0.010::double) as r, least(1.0, max(b.y + b.h) + 0.008::double) as bt from members group by all),
k as (select *, row_number() over (partition by video_id, seg_id order by y, x, grp) as region_no from env)
select video_id, seg_id, cast(region_no as int) as region_no, round_even(x, 6) as x, round_even(y, 6) as y, round_even(greatest(0.001, r - x), 6) as w, round_even(greatest(0.001, bt - y), 6) as h from k where region_no <= 10"""),
    "caption_recover": (caption_recover, f"""with {OBSERVATIONS}, days as (select * replace (video_id || '/' || cast(floor(t / 86400) as bigint) as video_id) from observations), {islands('days', 'text', str(RECOVERY.min_confidence))}, firsts as (select video_id, seg_no, min(t) as start_s, max(t) + 3600 as end_s, arg_min(text, (-confidence, ord)) as text, count(*) as observation_count from seg group by all),
rest as (select * from days where video_id not in (select video_id from firsts) and confidence >= {RECOVERY.retry_confidence}),
l2 as (select *, lag(t) over w as pt, lag(text) over w as pb from rest window w as (partition by video_id order by t, ord)),
s2 as (select *, sum(case when pt is null or t - pt > 86400 or text <> pb then 1 else 0 end) over (partition by video_id order by t, ord rows unbounded preceding) as seg_no from l2)
select video_id, start_s, end_s, text, observation_count from firsts union all select video_id, min(t), max(t) + 3600, arg_min(text, (-confidence, ord)), count(*) from s2 group by video_id, seg_no"""),
    "cleanup_regions": (cleanup_regions, CLEANUP_SQL),
    "detection_clusters": (detection_clusters, CLUSTER_SQL),
    "box_envelope": (box_envelope, f"with {OBSERVATIONS} select video_id, text, round(min(x::double), 6) as x, round(min(y::double), 6) as y, round(max((x + w)::double) - min(x::double), 6) as w, round(max((y + h)::double) - min(y::double), 6) as h from observations group by video_id, text"),
    "detail_boxes": (detail_boxes, f"""with {OBSERVATIONS}, b as (select ord, x::double as x, y::double as y, w::double as w, h::double as h from observations union all select ord, y, x, w, (ord % 4) / 1000.0 from observations
union all select ord, x / 2, y / 2, h, w from observations), k as (select *, row_number() over (partition by ord order by y, x, w, h) - 1 as p from b where w > 0.002 and h > 0.002)
select ord, cast(p as int) as pos, round_even({_pad('x', 'w', 0.004, 0.005)[0]}, 6) as x, round_even({_pad('y', 'h', 0.004, 0.005)[0]}, 6) as y, round_even({_pad('x', 'w', 0.004, 0.005)[1]}, 6) as w, round_even({_pad('y', 'h', 0.004, 0.005)[1]}, 6) as h from k"""),
    "text_similarity": (text_similarity, """with s as (select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9_]', '', 'g') as a, regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9_]', '', 'g') as b from part)
select p_partkey, round(1.0 - levenshtein(a, b) / greatest(length(a), length(b))::double, 9) as similarity from s"""),
    "text_similarity_exact": (text_similarity_exact, None),
    "consensus_of_texts": (consensus_of_texts, None),
    "robust_box": (robust_box, _quantile_sql(0.5, 0.5, 0.02, 0.015, 0.012, 0.008, "video_id, text")),
    "region_quantiles": (region_quantiles, _quantile_sql(0.05, 0.95, 0.03, 0.025, 0.025, 0.018, "video_id")),
    "region_sketches": (region_sketches, f"""with {OBSERVATIONS} select text, count(*) as boxes, count(distinct cast(floor(t / 86400) as bigint)) as days,
true as l_near, true as t_near, true as r_near, true as b_near from observations group by text"""),
    "region_side": (region_side, f"with {OBSERVATIONS} select video_id, text, case when sum((x + w / 2)::double * greatest(0.01, w)) / sum(greatest(0.01, w)::double) < 0.5 then 'left' else 'right' end as side from observations group by video_id, text"),
    "persistent_region": (persistent_region, PERSISTENT_SQL),
    "persistent_texts": (persistent_texts, PERSISTENT_SQL.split("hit as (")[0] + """first as (select video_id, side, cx, cy, min(ord) as first_ord from s group by all),
r as (select s.video_id, s.text, row_number() over (partition by s.video_id order by f.first_ord, s.ord) as n from s join first f using (video_id, side, cx, cy)
  semi join per p on p.video_id = s.video_id and p.side = s.side and p.cx = s.cx and p.cy = s.cy semi join (select * from ch where k = 1 and gain > 0) w on w.video_id = s.video_id and w.side = s.side where s.text <> '')
select video_id, string_agg(text, ',' order by n) as texts from r where n <= 8 group by video_id"""),
    "caption_placement": (caption_placement, _placement_sql()),
    "caption_lines": (caption_lines, LINES_SQL),
    "frame_texts": (frame_texts, f"""with {OBSERVATIONS}, {PX}, r as (select *, round_even(y / 67.2::double, 0) as rw from px)
select video_id, frame, string_agg(text, ' ' order by rw, x, det) as text, round(avg(confidence), 6) as confidence, count(*) as n_boxes, round(first(x / 1080 order by rw, x, det), 6) as x0, round(first(greatest(0.001, h / 1920) order by rw, x, det), 6) as h0 from r group by video_id, frame"""),
}
