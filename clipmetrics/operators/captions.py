"""Timed text observations to caption segments: acceptance, segmentation, consensus, refinement."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from clipmetrics import rules
from clipmetrics.functions import regions, similarity, text
from clipmetrics.functions.text import strip
from clipmetrics.operators import boxes as boxes_of
from clipmetrics.operators import shown
from clipmetrics.operators.folds import fold
from clipmetrics.operators.ordered import dense_ids, previous_within, running_counts
from clipmetrics.operators.votes import clusters, spokesman
from clipmetrics.params import CaptionParams
from clipmetrics.session import written

Ratio = Callable[[str, str], float]


def accept(observations: DataFrame, params: CaptionParams = CaptionParams()) -> DataFrame:
    """Confident texts of enough characters, squeezed."""
    squeezed = observations.withColumn("text", text.squeeze(F.col("text")))
    return squeezed.where((F.col("confidence") >= params.min_confidence) & (F.length("text") >= params.min_chars))


def _end(last: Column, params: CaptionParams, columns: list[str]) -> Column:
    """Last sample plus one interval, not beyond the video when its duration is known."""
    end = last + params.interval
    return F.least(end, F.max("duration")) if "duration" in columns else end


def runs(observations: DataFrame, params: CaptionParams = CaptionParams()) -> DataFrame:
    """Number gap-free stretches (island) and runs of equal text (run) inside every video."""
    keyed = observations.withColumn("cmp", text.comparable(F.col("text")))
    order = ["t", "ord"]
    linked = previous_within(keyed, ["video_id"], order, ["cmp", "t"], F.col("t"), max(params.slice_seconds, params.gap), params.gap)
    gap = F.col("prev_t").isNull() | (F.col("t") - F.col("prev_t") > params.gap)
    # A text without comparable characters resembles nothing, not even its copy.
    change = gap | (F.col("cmp") != F.col("prev_cmp")) | (F.col("cmp") == "")
    return running_counts(linked, ["video_id"], order, {"island": gap, "run": change}).drop("_slice", "prev_cmp", "prev_t")


def equal_text_segments(observations: DataFrame, params: CaptionParams = CaptionParams()) -> DataFrame:
    """Segments of unchanged text without a gap; the most confident spelling stands for the segment.

    Two-level: rows are numbered inside slices, slices are linked by summaries, then partial aggregates
    per segment are combined.
    """
    numbered = runs(observations, params)
    return numbered.groupBy("video_id", F.col("run").alias("seg_no")).agg(
        F.min("t").alias("start_s"), _end(F.max("t"), params, observations.columns).alias("end_s"),
        F.max_by("text", F.struct(F.col("confidence"), -F.col("ord"))).alias("text"),
        F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("observation_count"),
    )


def similar_text_segments(observations: DataFrame, params: CaptionParams = CaptionParams(),
                          ratio: Ratio = similarity.ratio) -> DataFrame:
    """Observations with a segment number, by similarity to the segment's current representative text.

    The representative changes while a segment grows, so each text depends on the one before. A gap always ends a
    segment, a run of equal text moves as one, and slices of time fold in parallel (see shown.segment_parts), so that
    no video is one task. Only run summaries go through the folds, and the result joins back by run. Both tables are
    read several times afterwards and are therefore written once.
    """
    numbered = written(runs(observations, params), "runs")
    # The first run of a segment sets the representative with its first confidence, later ones only raise it.
    summary = numbered.groupBy("video_id", "island", "run").agg(
        F.first("cmp").alias("cmp"), F.max("confidence").alias("best"), F.min("t").alias("t"),
    )
    parts = shown.segment_parts(summary, similarity.floored(ratio), params.text_similarity, max(params.slice_seconds, params.gap))
    joined = numbered.join(written(parts, "parts"), ["video_id", "island", "run"])
    return joined.withColumn("seg", F.struct("island", "part"))


def segment_rows(numbered: DataFrame, params: CaptionParams = CaptionParams()) -> DataFrame:
    """One row per segment of similar_text_segments, without a vote: the most confident spelling stands for it."""
    out = numbered.groupBy("video_id", "seg").agg(
        F.min("t").alias("start_s"), _end(F.max("t"), params, numbered.columns).alias("end_s"),
        F.max_by("text", F.struct(F.col("confidence"), -F.col("ord"))).alias("text"),
        F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("observation_count"),
    )
    return out.drop("seg")


_CONSENSUS = [
    StructField("text", StringType()), StructField("confidence", DoubleType()), StructField("consensus_score", DoubleType()),
    StructField("observation_count", LongType()), StructField("winner_count", LongType()),
    StructField("representative_ord", LongType()), StructField("winners", ArrayType(StringType())),
]


def _vote(threshold: float, ratio: Ratio):
    """Greedy clustering of distinct texts in order of first appearance, weighted by how often each occurred."""
    close, bounded = similarity.floored(ratio), ratio is similarity.ratio and threshold > 0

    def step(key: tuple, rows: Iterator[tuple]) -> Iterable[tuple]:
        items = list(rows)  # distinct texts of one segment
        groups = clusters([item[0] for item in items], threshold, close, bounded)
        # Texts without any comparable character never join: they count as one observation each.
        votes = lambda i: items[i][1] if items[i][0] else 1
        weight = lambda i: items[i][2] if items[i][0] else items[i][3]
        winner = max(groups, key=lambda c: (sum(map(votes, c)), sum(map(weight, c))))
        size = sum(map(votes, winner))

        def peers_of(place: int) -> float:
            i = winner[place]
            return sum(votes(j) * (1.0 if i == j else ratio(items[i][0], items[j][0])) for j in winner)

        def standing(place: int, peers: float) -> tuple[float, int]:
            item = items[winner[place]]
            agreement = (peers - 1.0) / (size - 1) if size > 1 else 1.0
            return agreement * 0.82 + item[3] * 0.18, -item[4]

        chosen = winner[spokesman([items[i][0] for i in winner], [votes(i) for i in winner], standing, peers_of, bounded)]
        usable = sum(item[1] for item in items)
        yield (*key, items[chosen][5].strip(), sum(map(weight, winner)) / size, size / usable, usable, size,
               items[chosen][4], [items[i][0] for i in winner])
    return step


def consensus(observations: DataFrame, keys: list[str], params: CaptionParams = CaptionParams(),
              ratio: Ratio = similarity.ratio) -> DataFrame:
    """Text of a segment by the votes of all its observations.

    Equal texts always end in the same cluster, so they are counted first (map-side) and the fold sees
    each distinct text once, with its number, total confidence and best observation. A text is compared with those that
    share enough pairs of characters with it, not with all others (see votes); a ratio of your own is asked for all.
    """
    trust = F.greatest(F.lit(0.0), F.coalesce(F.col("confidence"), F.lit(0.0)))
    counted = (
        observations.where(text.squeeze(F.col("text")) != "")
        .withColumn("cmp", text.comparable(F.col("text"))).withColumn("_trust", trust)
        .groupBy(*keys, "cmp").agg(
            F.count(F.lit(1)).alias("n"), F.sum("_trust").alias("total"), F.min("ord").alias("first_ord"),
            F.max(F.struct(F.col("_trust"), (-F.col("ord")).alias("o"), F.col("text"))).alias("b"),
        )
        .select(*keys, "cmp", "n", "total", "first_ord", F.col("b._trust").alias("best"), (-F.col("b.o")).alias("best_ord"),
                F.col("b.text").alias("best_text"))
    )
    fields = [f for f in counted.schema.fields if f.name in keys]
    schema = StructType(sorted(fields, key=lambda f: keys.index(f.name)) + _CONSENSUS)
    return fold(counted, keys, ["first_ord"], ["cmp", "n", "total", "best", "best_ord", "best_text"],
                _vote(params.consensus_similarity, ratio), schema)


def consensus_aggregate(params: CaptionParams = CaptionParams(), ratio: Ratio = similarity.ratio):
    """The vote as an aggregate function for SQL users: consensus_text(text, confidence, ord) of one segment.

    A grouped pandas function holds its group in memory, so it is meant for groups the size of a
    segment; consensus() is the form for everything else. It costs milliseconds a group; for very many groups
    consensus_of_list() votes over the observations an aggregate of Spark's own has gathered.
    """
    winner = _winner(_vote(params.consensus_similarity, ratio))

    @F.pandas_udf(StringType())
    def consensus_text(texts: pd.Series, confidence: pd.Series, ords: pd.Series) -> str:
        return winner(ords.tolist(), texts.tolist(), confidence.tolist())

    return consensus_text


def _winner(vote: Callable) -> Callable[[list, list, list], str | None]:
    """The text of one segment from its observations in any order."""

    def text_of(ords: list, texts: list, confidence: list) -> str | None:
        trust = [c if c is not None and c > 0.0 else 0.0 for c in confidence]
        counted: dict[str, list] = {}
        for at, value, sure in sorted(zip(ords, [t if isinstance(t, str) else "" for t in texts], trust)):
            if similarity.squeezed(value) == "":
                continue
            seen = counted.setdefault(similarity.comparable(value), [0, 0.0, -1.0, at, value])
            seen[0] += 1
            seen[1] += sure
            if sure > seen[2]:
                seen[2:] = [sure, at, value]
        items = ((cmp, *rest) for cmp, rest in counted.items())
        return next(iter(vote((), items)))[0] if counted else None

    return text_of


def consensus_of_list(params: CaptionParams = CaptionParams(), ratio: Ratio = similarity.ratio):
    """The vote over collect_list(struct(text, confidence, ord)) of a segment, many segments in one Arrow batch."""
    winner = _winner(_vote(params.consensus_similarity, ratio))

    @F.arrow_udf(StringType())
    def consensus_of(segments: pa.Array) -> pa.Array:
        seen = segments.flatten()
        texts, confidence, ords = (seen.field(n).to_pylist() for n in range(3))
        ends = pc.list_value_length(segments).fill_null(0).to_numpy(zero_copy_only=False).cumsum().tolist()
        ords = [math.nan if at is None else at for at in ords]
        spans = [slice(start, end) for start, end in zip([0, *ends], ends)]
        return pa.array([winner(ords[s], texts[s], confidence[s]) for s in spans], pa.string())

    return consensus_of


def register_consensus(spark: SparkSession, name: str = "consensus_text") -> None:
    """name as an aggregate over one segment's rows, name_of over their list."""
    spark.udf.register(name, consensus_aggregate())
    spark.udf.register(f"{name}_of", consensus_of_list())


def exact_text_vote(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Consensus without similarity: most frequent squeezed text, then total confidence, then text."""
    usable = observations.withColumn("_text", text.squeeze(F.col("text"))).where(F.col("_text") != "")
    per_text = usable.groupBy(*keys, "_text").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("total"))
    order = F.struct("n", "total", "_text")
    voted = per_text.groupBy(*keys).agg(F.max(order).alias("w"), F.sum("n").alias("observation_count"))
    return voted.select(
        *keys, F.col("w._text").alias("text"), (F.col("w.total") / F.col("w.n")).alias("confidence"),
        (F.col("w.n") / F.col("observation_count")).alias("consensus_score"), "observation_count",
        F.col("w.n").alias("winner_count"),
    )


def not_persistent(segments: DataFrame, params: CaptionParams = CaptionParams()) -> DataFrame:
    """Too short segments and long unchanging labels removed."""
    seconds = F.col("end_s") - F.col("start_s")
    label = (seconds >= params.persistent_seconds) & (F.col("observation_count") >= params.persistent_observations)
    keep = ~label if params.persistent_seconds > 0 else F.lit(True)
    return segments.where((seconds >= params.min_duration) & keep)


def finalize(numbered: DataFrame, params: CaptionParams = CaptionParams(), ratio: Ratio = similarity.ratio) -> DataFrame:
    """Observations numbered by similar_text_segments to final segments with dense ids."""
    numbered = numbered.withColumns({"island": F.col("seg.island"), "part": F.col("seg.part")})
    keys = ["video_id", "island", "part"]
    spans = numbered.groupBy(*keys).agg(
        F.min("t").alias("start_s"), _end(F.max("t"), params, numbered.columns).alias("end_s"), F.min_by("ord", F.struct("t", "ord")).alias("first_ord"),
    )
    voted = consensus(numbered, keys, params, ratio)
    kept = not_persistent(spans.join(voted, keys), params)
    kept = written(kept, "segments")
    rounded = kept.withColumn("confidence", F.bround("confidence", 4)).withColumn("consensus_score", F.bround("consensus_score", 4))
    return dense_ids(rounded, ["video_id"], ["start_s", "island", "part"], "seg_id", F.col("start_s"), params.slice_seconds)


def with_geometry(segments: DataFrame, observations: DataFrame, threshold: float = 0.68, fine: DataFrame | None = None) -> DataFrame:
    """bbox, detail regions and placement of each segment from the boxes of one observation.

    That is the representative one: of the finer observations where a refinement was taken, else of the segment's own;
    if it has no boxes, the next in this order, and last the segment's first observation.
    """
    sources = [("refined_ord", fine), ("representative_ord", observations), ("first_ord", observations)]
    joined, found = segments, []
    for column, rows in sources:
        if rows is not None and column in segments.columns:
            boxes = rows.select("video_id", F.col("ord").alias(column), F.col("boxes").alias(f"_{column}"))
            joined = joined.join(boxes, ["video_id", column], "left")
            found.append(F.when(F.size(f"_{column}") > 0, F.col(f"_{column}")))
    shape = regions.segment_geometry(F.coalesce(*found), threshold=threshold)
    return joined.withColumn("_g", shape).select(*segments.columns, "_g.bbox", "_g.regions", "_g.placement")


def cleanup_of_winners(segments: DataFrame, numbered: DataFrame, limit: int = 10) -> DataFrame:
    """video_id, seg_id, region_no and box of what to clean: the stable envelopes of the boxes of a segment's winners.

    segments come from finalize, numbered from similar_text_segments over observations with boxes.
    """
    wins = segments.select("video_id", "seg_id", "island", "part", F.explode("winners").alias("cmp"))
    seen = numbered.select(
        "video_id", F.col("seg.island").alias("island"), F.col("seg.part").alias("part"), text.comparable(F.col("text")).alias("cmp"),
        "ord", F.posexplode("boxes").alias("pos", "b"))
    order = Window.partitionBy("video_id", "seg_id").orderBy("ord", "pos")
    items = seen.join(wins, ["video_id", "island", "part", "cmp"]).withColumn("item", F.row_number().over(order).cast("long"))
    return boxes_of.cleanup_regions(items.select("video_id", "seg_id", "item", "b.*"), ["video_id", "seg_id"], limit=limit)


def uncertain(confidence: Column, score: Column, observed: Column, params: CaptionParams = CaptionParams()) -> Column:
    return (confidence < params.refine_confidence) | (score < params.refine_consensus) | (observed < params.refine_observations)


def to_refine(segments: DataFrame, params: CaptionParams = CaptionParams()) -> DataFrame:
    """First uncertain segments of each video; the bound is applied before the shuffle as well."""
    doubtful = segments.where(uncertain(F.col("confidence"), F.col("consensus_score"), F.col("observation_count"), params))
    order = Window.partitionBy("video_id").orderBy("seg_id")
    return doubtful.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= params.refine_per_video).drop("_n")


def sample_times(start: Column, end: Column, count: int) -> Column:
    """Array of sample times inside a segment, away from its edges."""
    ratios = F.array(*[F.lit(r) for r in rules.SAMPLE_RATIOS[min(5, max(1, count))]])
    inside = F.transform(ratios, lambda r: start + (end - start) * r)
    return F.when(end > start, inside).otherwise(F.array(F.greatest(F.lit(0.0), start)))


def refinement_observations(segments: DataFrame, fine: DataFrame, params: CaptionParams = CaptionParams()) -> DataFrame:
    """The finer observation nearest to every sample time, at most half an interval away.

    Equi join on (video, time cell): a sample looks into its own cell and both neighbours.
    """
    reach = params.interval / 2
    samples = segments.select("video_id", "seg_id", F.posexplode(sample_times(F.col("start_s"), F.col("end_s"), params.refine_samples)).alias("sample", "at"))
    cell = F.floor(F.col("at") / reach)
    asked = samples.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    seen = fine.where(F.col("confidence") >= params.refine_min_confidence).withColumn("cell", F.floor(F.col("t") / reach))
    near = asked.join(seen, ["video_id", "cell"]).where(F.abs(F.col("t") - F.col("at")) <= reach)
    nearest = F.min_by(F.struct("ord", "text", F.col("confidence")), F.struct(F.abs(F.col("t") - F.col("at")), F.col("ord")))
    return near.groupBy("video_id", "seg_id", "sample").agg(nearest.alias("o")).select("video_id", "seg_id", "sample", "o.*")


def refine(segments: DataFrame, fine: DataFrame, params: CaptionParams = CaptionParams(), ratio: Ratio = similarity.ratio) -> DataFrame:
    """Uncertain segments voted again on finer observations; a better result replaces the old one.

    refined_ord is the finer observation that stands for a replaced segment, for its geometry.
    """
    again = refinement_observations(to_refine(segments, params), fine, params)
    voted = consensus(again.withColumn("ord", F.col("sample").cast("long")), ["video_id", "seg_id"], params, ratio)
    fresh = ["text", "confidence", "consensus_score", "observation_count", "winner_count"]
    shown = again.select("video_id", "seg_id", F.col("sample").cast("long").alias("representative_ord"), F.col("ord").alias("n_ord"))
    update = voted.join(shown, ["video_id", "seg_id", "representative_ord"]).select(
        "video_id", "seg_id", "n_ord", *[F.col(c).alias(f"n_{c}") for c in fresh])
    both = segments.join(update, ["video_id", "seg_id"], "left")
    better = (
        (F.col("n_winner_count") >= min(2, params.refine_samples)) | (F.col("n_confidence") >= F.col("confidence") + 0.05)
        | (F.col("n_consensus_score") >= 0.80)
    )
    take = F.coalesce(better, F.lit(False))
    digits = {"confidence": F.bround("n_confidence", 4), "consensus_score": F.bround("n_consensus_score", 4)}
    replaced = {c: F.when(F.col("_take"), digits.get(c, F.col(f"n_{c}"))).otherwise(F.col(c)) for c in fresh}
    return both.withColumn("_take", take).withColumns(replaced).withColumns({
        "refined": F.col("_take"), "refined_ord": F.when(F.col("_take"), F.col("n_ord"))}).select(*segments.columns, "refined", "refined_ord")


def recover_empty(observations: DataFrame, segment: Callable[[DataFrame, CaptionParams], DataFrame],
                  params: CaptionParams = CaptionParams()) -> DataFrame:
    """Segment all videos; those without any segment once more with a lower confidence bound."""
    first = segment(accept(observations, params), params)
    looser = CaptionParams(**{**params.__dict__, "min_confidence": params.retry_confidence})
    missed = observations.join(first.select("video_id").distinct(), "video_id", "left_anti")
    return first.unionByName(segment(accept(missed, looser), looser))


_LINE = StructType([
    StructField("video_id", StringType()), StructField("frame", LongType()), StructField("det", LongType()),
    StructField("line", LongType()),
])


def _group_lines(tolerance: float):
    def step(key: tuple, rows: Iterator[tuple]) -> Iterable[tuple]:
        centres: list[tuple[float, int]] = []  # sum and number of the middles of a line
        for det, middle in rows:
            hit = next((n for n, (total, count) in enumerate(centres) if abs(middle - total / count) <= tolerance), len(centres))
            if hit == len(centres):
                centres.append((0.0, 0))
            total, count = centres[hit]
            centres[hit] = total + middle, count + 1
            yield (*key, det, hit)
    return step


def caption_lines(detections: DataFrame, frame_w: float, frame_h: float, tolerance: float = 0.045, two_line_gap: float = 0.15) -> DataFrame:
    """detections(video_id, frame, det, x, y, w, h, text, confidence) in pixels: those of the best caption line or pair.

    Lines are grouped per frame in reading order; single lines and neighbouring pairs are then scored
    with plain expressions over arrays of lines.
    """
    middle = detections.withColumn("middle", F.col("y") + F.col("h") / 2)
    lines = fold(middle, ["video_id", "frame"], ["y", "x", "det"], ["det", "middle"], _group_lines(max(8.0, frame_h * tolerance)), _LINE)
    tagged = detections.join(lines, ["video_id", "frame", "det"])
    parts = tagged.groupBy("video_id", "frame", "line").agg(
        F.min("x").alias("l"), F.max(F.col("x") + F.col("w")).alias("r"), F.min("y").alias("t"), F.max(F.col("y") + F.col("h")).alias("b"),
        F.sum("confidence").alias("conf"), F.count(F.lit(1)).alias("n"), F.sum(F.length(text.squeeze(F.col("text")))).alias("chars"),
    )
    ahead = Window.partitionBy("video_id", "frame").orderBy("line")
    stat = F.struct("l", "r", "t", "b", "conf", "n", "chars")
    paired = parts.select("video_id", "frame", "line", stat.alias("a"), F.lead(stat).over(ahead).alias("z"))

    def rank(s: Column) -> Column:
        coverage = F.greatest(F.lit(0.0), s.r - s.l) / max(1.0, frame_w)
        centre = F.greatest(F.lit(0.0), 1.0 - F.abs((s.l + s.r) / 2.0 / max(1.0, frame_w) - 0.5) * 2.0)
        height = (s.t + s.b) / 2.0 / max(1.0, frame_h)
        filled = F.least(F.lit(1.0), s.chars / 18.0)
        return 1.55 * s.conf / s.n + 0.75 * F.least(F.lit(1.0), coverage / 0.55) + 0.35 * centre + 0.55 * filled + 0.15 * height

    a, z = F.col("a"), F.col("z")
    both = F.struct(F.least(a.l, z.l).alias("l"), F.greatest(a.r, z.r).alias("r"), F.least(a.t, z.t).alias("t"), F.greatest(a.b, z.b).alias("b"),
                    (a.conf + z.conf).alias("conf"), (a.n + z.n).alias("n"), (a.chars + z.chars).alias("chars"))
    close = z.isNotNull() & (F.abs((a.t + a.b) / 2 - (z.t + z.b) / 2) / max(1.0, frame_h) <= two_line_gap)
    order = lambda score, pair: F.struct(score.alias("score"), (-F.col("line")).alias("first"), F.lit(-pair).alias("pair"))
    best = F.greatest(order(rank(a), 0), F.when(close, order(rank(both), 1)))
    chosen = paired.groupBy("video_id", "frame").agg(F.max(best).alias("c"))
    first, pair = -F.col("c.first"), -F.col("c.pair")
    kept = tagged.join(chosen, ["video_id", "frame"]).where(F.col("line").between(first, first + pair))
    return kept.select(*detections.columns, "line")


def frame_texts(detections: DataFrame, frame_w: float, frame_h: float, row_height: float = 0.035) -> DataFrame:
    """One observation per frame: texts in reading order, mean confidence, normalised boxes."""
    row = F.bround(F.col("y") / max(1.0, frame_h * row_height)).cast("long")
    shape = regions.box(F.col("x") / frame_w, F.col("y") / frame_h, F.greatest(F.lit(0.001), F.col("w") / frame_w), F.greatest(F.lit(0.001), F.col("h") / frame_h))
    item = F.struct(row.alias("row"), F.col("x"), F.col("det"), F.col("text"), shape.alias("box"))
    framed = detections.groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(item)).alias("items"), F.avg("confidence").alias("confidence"))
    return framed.select(
        "video_id", "frame", strip(F.array_join(F.transform("items", lambda i: i.text), " ")).alias("text"), "confidence",
        F.transform("items", lambda i: i.box).alias("boxes"),
    )
