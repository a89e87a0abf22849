"""Subtitle cues: interval merging, packing, splitting, matching with segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from clipmetrics.functions import regions, text
from clipmetrics.functions.text import strip
from clipmetrics.operators.folds import fold
from clipmetrics.operators.ordered import SLICE, running_counts, running_max, with_slices
from clipmetrics.params import MatchParams, PackingParams
from clipmetrics.session import written

ORDER = ["start_s", "ord"]


def merge_intervals(cues: DataFrame, max_gap: float = 0.30, slice_seconds: float = 600.0) -> DataFrame:
    """cues(video_id, ord, start_s, end_s) merged where the pause to everything before is at most max_gap.

    Merging is associative: intervals are first merged inside their slice, where the shuffle has put
    them, and only the merged ones are then linked over slices.
    """
    valid = cues.select("video_id", "start_s", "end_s").where(F.col("end_s") > F.col("start_s"))
    sliced = with_slices(valid, F.col("start_s"), slice_seconds)
    inside = Window.partitionBy("video_id", SLICE).orderBy("start_s", "end_s")
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    fresh = lambda reach: (reach.isNull() | (F.col("start_s") - reach > max_gap))
    local = sliced.withColumn("_new", fresh(F.max("end_s").over(before)).cast("int")).withColumn("_part", F.sum("_new").over(upto))
    merged = local.groupBy("video_id", SLICE, "_part").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("cues"))
    reached = running_max(merged, ["video_id"], ["start_s"], F.col("end_s"), "reach")
    numbered = running_counts(reached, ["video_id"], ["start_s"], {"part": fresh(F.col("reach"))})
    return numbered.groupBy("video_id", "part").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("cues").alias("cues"))


_CHUNK = StructType([
    StructField("video_id", StringType()), StructField("first_ord", LongType()), StructField("start_s", DoubleType()),
    StructField("end_s", DoubleType()), StructField("cues", LongType()), StructField("text", StringType()),
])
_LINK = StructType([
    StructField("video_id", StringType()), StructField(SLICE, LongType()), StructField("place", LongType()), StructField("start_s", DoubleType()),
    StructField("ord", LongType()), StructField("shared", BooleanType()), StructField("next_start", DoubleType()), StructField("next_ord", LongType()),
])
_ENTRY = StructType([StructField("video_id", StringType()), StructField(SLICE, LongType()), StructField("entry", LongType())])


class _Groups:
    """The cues of one slice, those of the next that a group of this one can reach included, and where each group ends.

    Rows are ord, start, end, text, whether the slice owns the cue, and whether the slice before reaches it too.
    """

    def __init__(self, rows: Iterator[tuple], params: PackingParams) -> None:
        self.rows, self.params = list(rows), params
        self.owned = sum(r[4] for r in self.rows)

    def end(self, first: int) -> int:
        """The first cue that a group beginning at `first` cannot take."""
        rows, p = self.rows, self.params
        start, size, at = rows[first][1], len(rows[first][3]), first + 1
        while at < len(rows):
            _, s, e, t, *_ = rows[at]
            size += 1 + len(t)
            if s - rows[at - 1][2] > p.max_gap or size > p.max_chars or max(s, e) - start > p.max_duration:
                break
            at += 1
        return at


def _links(params: PackingParams):
    def step(key: tuple, rows: Iterator[tuple]) -> Iterable[tuple]:
        """For every cue a group may have to begin with: the first one after the slice that a group then begins with."""
        groups = _Groups(rows, params)
        candidates = [i for i in range(groups.owned) if groups.rows[i][5]]
        candidates += [i for i in range(groups.owned) if not groups.rows[i][5]][:1]
        leaves: dict[int, int] = {}
        for at in reversed(candidates):
            path = []
            while at < groups.owned and at not in leaves:
                path.append(at)
                at = groups.end(at)
            leaves.update(dict.fromkeys(path, leaves.get(at, at)))
        for place in candidates:
            ord_, start, _, _, _, shared = groups.rows[place]
            after = groups.rows[leaves[place]] if leaves[place] < len(groups.rows) else (None, None)
            yield (*key, place, start, ord_, shared, after[1], after[0])
    return step


def _entries(key: tuple, rows: Iterator[tuple]) -> Iterable[tuple]:
    """The cue that the first group of each slice of a video begins with, from one slice to the next."""
    wanted, after = None, None  # a place in order, or none: then whatever the slice `after` could not reach
    for slice_no, candidates in groupby(rows, key=lambda r: r[0]):
        for _, place, start, ord_, shared, next_start, next_ord in candidates:
            if (start, ord_) >= wanted if wanted else not (shared and after == slice_no - 1):
                yield (*key, slice_no, place)
                wanted, after = (next_start, next_ord) if next_start is not None else None, slice_no
                break
        else:
            # All cues of this slice went into a group of the one before; so far nothing else is known of the next.
            after = after if wanted else None


def _packed(params: PackingParams):
    def step(key: tuple, rows: Iterator[tuple]) -> Iterable[tuple]:
        first = next(rows)
        groups = _Groups((r[1:] for r in chain([first], rows)), params)
        at = first[0]
        while at < groups.owned:
            end = groups.end(at)
            members = groups.rows[at:end]
            yield (key[0], members[0][0], members[0][1], members[-1][2], len(members), " ".join(r[3] for r in members))
            at = end
    return step


def pack_speech(cues: DataFrame, params: PackingParams = PackingParams(), slice_seconds: float = 600.0) -> DataFrame:
    """Greedy groups of neighbouring cues for speech: characters, duration and pause bounded.

    A group reaches no further than max_duration, so a time slice that also sees the cues up to there knows, for every
    cue a group may begin with, where the next ones begin and which is the first of them beyond the slice. These links, a
    few rows a slice, are followed once per video; then every slice packs its own groups. No video, however long and
    however free of pauses, is packed by one task. A cue that ends before it starts counts as ending where it starts.
    """
    width = max(slice_seconds, params.max_duration)
    spoken = cues.withColumn("text", strip("text")).where(F.col("text") != "")
    own, reached = F.floor(F.col("start_s") / width), F.floor((F.col("start_s") - params.max_duration) / width)
    rows = written(
        spoken.select(F.col("video_id").cast("string").alias("video_id"), "ord", F.col("start_s").cast("double").alias("start_s"),
                      F.col("end_s").cast("double").alias("end_s"), "text", own.alias("_own"), (reached < own).alias("shared"),
                      F.explode(F.sequence(reached, own)).alias(SLICE))
        .withColumn("owned", F.col(SLICE) == F.col("_own")).drop("_own"), "speech-slices")
    values = ["ord", "start_s", "end_s", "text", "owned", "shared"]
    links = fold(rows, ["video_id", SLICE], ORDER, values, _links(params), _LINK)
    entries = fold(links, ["video_id"], [SLICE, "place"], [SLICE, "place", "start_s", "ord", "shared", "next_start", "next_ord"], _entries, _ENTRY)
    ready = rows.join(entries, ["video_id", SLICE])
    return fold(ready, ["video_id", SLICE], ORDER, ["entry", *values], _packed(params), _CHUNK)


def _join_up(pieces: Column, limit: int) -> Column:
    """Greedy packing of pieces of one text, joined by blanks."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, piece: Column) -> Column:
        full = (state.open != "") & (F.length(state.open) + F.length(piece) >= limit)
        closed = F.struct(F.concat(state.done, F.array(state.open)).alias("done"), piece.alias("open"))
        longer = F.concat_ws(" ", F.nullif(state.open, F.lit("")), piece)
        return F.when(full, closed).otherwise(F.struct(state.done.alias("done"), longer.alias("open")))

    close = lambda s: F.filter(F.concat(s.done, F.array(s.open)), lambda c: c != "")
    return F.aggregate(pieces, empty, add, close)


def split_long_texts(df: DataFrame, keys: list[str], column: str = "text", limit: int = 90) -> DataFrame:
    """Texts as pieces of at most limit characters: by sentences, then words, then hard cuts."""
    def pieces(sentence: Column) -> Column:
        words = F.filter(F.split(sentence, text.SPACE), lambda w: w != "")
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length(sentence) - 1) / limit).cast("int")),
                           lambda i: F.substring(sentence, i * limit + 1, F.lit(limit)))
        return F.when(F.length(sentence) <= limit, F.array(sentence)).when(F.size(words) <= 1, cuts).otherwise(_join_up(words, limit))

    clean = df.select(*keys, text.speech_text(F.col(column)).alias("_clean")).where(F.col("_clean") != "")
    sentences = F.filter(F.transform(F.split("_clean", r"(?<=[.!?。！？;；:：,，])\s*"), lambda s: strip(s)), lambda s: s != "")
    packed = _join_up(F.flatten(F.transform(sentences, pieces)), limit)
    parts = F.when(F.length("_clean") <= limit, F.array("_clean")).otherwise(packed)
    return clean.select(*keys, F.posexplode(parts).alias("piece_no", "piece"))


def _cells(low: Column, high: Column, width: float) -> Column:
    return F.sequence(F.floor(low / width), F.floor(high / width))


def match_cues(cues: DataFrame, segments: DataFrame, params: MatchParams = MatchParams()) -> DataFrame:
    """Segment of every cue: largest time overlap, else nearest centre within max_gap; ties go to the first segment.

    cues(video_id, ord, start_s, end_s), segments(video_id, seg_id, start_s, end_s). Matching runs on
    distinct intervals: equal segments collapse to the first one and equal cues get the same answer, so
    copies do not multiply. Both sides meet in time cells of their video, so a long video is spread over
    many keys and no pair is formed that is not close in time.
    """
    span = ["video_id", "start_s", "end_s"]
    wanted = cues.select(*span).distinct().withColumnsRenamed({"start_s": "cs", "end_s": "ce"})
    usable = segments.where(F.col("end_s") > F.col("start_s"))
    offered = usable.groupBy(*span).agg(F.min("seg_id").alias("seg_id")).withColumnsRenamed({"start_s": "ss", "end_s": "se"})
    width = params.bucket_seconds
    centre_c, centre_s = (F.col("cs") + F.col("ce")) / 2, (F.col("ss") + F.col("se")) / 2
    # A cue looks where it lasts and where a centre may be near; a segment lies where it lasts (its centre included).
    look = _cells(F.least(F.col("cs"), centre_c - params.max_gap), F.greatest(F.col("ce"), centre_c + params.max_gap), width)
    asked = wanted.withColumn("cell", F.explode(look))
    placed = offered.withColumn("cell", F.explode(_cells(F.col("ss"), F.col("se"), width)))
    shared = F.greatest(F.lit(0.0), F.least("ce", "se") - F.greatest("cs", "ss"))
    apart = F.abs(centre_c - centre_s)
    pairs = asked.join(placed, ["video_id", "cell"]).select(
        "video_id", "cs", "ce", "seg_id", shared.alias("shared"), apart.alias("apart"),
    ).where((F.col("shared") > 0) | (F.col("apart") <= params.max_gap))
    by_overlap = F.max(F.when(F.col("shared") > 0, F.struct("shared", (-F.col("seg_id")).alias("s"))))
    by_centre = F.min(F.when(F.col("apart") <= params.max_gap, F.struct("apart", F.col("seg_id").alias("s"))))
    best = pairs.groupBy("video_id", "cs", "ce").agg(by_overlap.alias("o"), by_centre.alias("n")).select(
        "video_id", F.col("cs").alias("start_s"), F.col("ce").alias("end_s"),
        F.coalesce(-F.col("o.s"), F.col("n.s")).alias("seg_id"), F.coalesce(F.col("o.shared"), F.lit(0.0)).alias("shared"),
    )
    return cues.join(best, span, "left")


def place_cues(cues: DataFrame, segments: DataFrame, params: MatchParams = MatchParams(),
               fallback: tuple[float, float, float, float] = regions.DEFAULT_REGION) -> DataFrame:
    """Cues with the box of their segment, the fallback without one; bottom boxes get a minimum size.

    segments(video_id, seg_id, start_s, end_s, bbox, placement).
    """
    matched = match_cues(cues, segments, params)
    shapes = segments.select("video_id", "seg_id", "bbox", "placement")
    joined = matched.join(shapes, ["video_id", "seg_id"], "left")
    source = F.coalesce(F.col("bbox"), regions.box(*fallback))
    named = F.when(F.col("placement").isin("bottom", "upper"), F.col("placement") == "bottom")
    bottom = F.coalesce(named, source.y + source.h >= params.bottom_threshold)
    target = F.when(bottom, regions.grown(source, params.min_bottom_width, params.min_bottom_height)).otherwise(source)
    return joined.select(*cues.columns, "seg_id", F.col("seg_id").isNotNull().alias("matched"), bottom.alias("bottom"), target.alias("region"))
