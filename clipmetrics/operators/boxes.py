"""Region aggregates: envelopes, robust boxes, persistent regions, temporal merging, safe zones."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import product
from math import floor, frexp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clipmetrics.functions import regions
from clipmetrics.functions.text import strip
from clipmetrics.operators.folds import fold
from clipmetrics.params import PersistentParams
from clipmetrics.session import written


def edges(b: str | None = None) -> tuple[Column, Column, Column, Column]:
    """left, top, right, bottom of a box column (or of plain x, y, w, h columns)."""
    at = lambda k: F.col(f"{b}.{k}" if b else k)
    return at("x"), at("y"), at("x") + at("w"), at("y") + at("h")


def envelope(df: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest box around all boxes of a key."""
    left, top, right, bottom = edges()
    agg = df.groupBy(*keys).agg(F.min(left).alias("l"), F.min(top).alias("t"), F.max(right).alias("r"), F.max(bottom).alias("b"))
    return agg.select(*keys, F.col("l").alias("x"), F.col("t").alias("y"), (F.col("r") - F.col("l")).alias("w"), (F.col("b") - F.col("t")).alias("h"))


def _quantiles(df: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Exact edge quantiles with linear interpolation; the state of a key grows with its distinct edges."""
    left, top, right, bottom = edges()
    return df.groupBy(*keys).agg(
        F.percentile(left, low).alias("l"), F.percentile(top, low).alias("t"),
        F.percentile(right, high).alias("r"), F.percentile(bottom, high).alias("b"),
    )


def edge_sketches(df: DataFrame, keys: list[str], size: int = 1000, unit: str | None = None) -> DataFrame:
    """Partial results to store and merge later: a KLL sketch of every edge, and an HLL sketch of the distinct values of unit.

    Their size does not grow with the rows of a key. At size 1000 a quantile's rank is within 0.4 % of the wanted one in 99 of
    100 cases; keys of at most `size` boxes are exact up to interpolation. Boxes with a null edge count for the other edges.
    """
    sketches = [F.kll_sketch_agg_double(edge.cast("double"), F.lit(size)).alias(f"{n}_sketch") for n, edge in zip("ltrb", edges())]
    units = [F.hll_sketch_agg(unit).alias("unit_sketch")] if unit else []
    return df.groupBy(*keys).agg(*sketches, *units)


def merge_sketches(partials: DataFrame, keys: list[str], size: int = 1000) -> DataFrame:
    """edge_sketches of parts (days, files) as those of the whole."""
    merged = [F.kll_merge_agg_double(f"{n}_sketch", F.lit(size)).alias(f"{n}_sketch") for n in "ltrb"]
    units = [F.hll_union_agg("unit_sketch").alias("unit_sketch")] if "unit_sketch" in partials.columns else []
    return partials.groupBy(*keys).agg(*merged, *units)


def sketched_quantiles(sketches: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Edge quantiles l, t (low) and r, b (high) from sketches, with the number of boxes seen and, if kept, of distinct units."""
    edge = [F.kll_sketch_get_quantile_double(f"{n}_sketch", F.lit(q)).alias(n) for n, q in zip("ltrb", (low, low, high, high))]
    units = [F.hll_sketch_estimate("unit_sketch").alias("units")] if "unit_sketch" in sketches.columns else []
    return sketches.select(*keys, *edge, F.kll_sketch_get_n_double("l_sketch").alias("boxes"), *units)


def _robust(q: DataFrame, keys: list[str]) -> DataFrame:
    raw = regions.box(F.col("l"), F.col("t"), F.greatest(F.lit(0.02), F.col("r") - F.col("l")), F.greatest(F.lit(0.015), F.col("b") - F.col("t")))
    return q.select(*keys, regions.rounded(regions.padded(raw, 0.012, 0.008, 0.01)).alias("box"))


def _region(q: DataFrame, keys: list[str]) -> DataFrame:
    raw = regions.box(F.col("l"), F.col("t"), F.greatest(F.lit(0.03), F.col("r") - F.col("l")), F.greatest(F.lit(0.025), F.col("b") - F.col("t")))
    return q.select(*keys, regions.padded(raw, 0.025, 0.018, 0.01).alias("box"))


def robust_box(df: DataFrame, keys: list[str]) -> DataFrame:
    """Median of every edge, padded: one stray hit does not move the box."""
    return _robust(_quantiles(df, keys, 0.5, 0.5), keys)


def text_region(df: DataFrame, keys: list[str]) -> DataFrame:
    """Region that holds nearly all text: 5 % and 95 % edge quantiles, padded."""
    return _region(_quantiles(df, keys, 0.05, 0.95), keys)


def robust_box_of(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """robust_box from edge_sketches, for keys of any number of boxes."""
    return _robust(sketched_quantiles(sketches, keys, 0.5, 0.5), keys)


def text_region_of(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """text_region from edge_sketches, for keys of any number of boxes."""
    return _region(sketched_quantiles(sketches, keys, 0.05, 0.95), keys)


def side(df: DataFrame, keys: list[str]) -> DataFrame:
    """left or right from the width-weighted mean centre."""
    weight = F.greatest(F.lit(0.01), F.col("w"))
    agg = df.groupBy(*keys).agg(F.sum((F.col("x") + F.col("w") / 2) * weight).alias("m"), F.sum(weight).alias("s"))
    centre = F.col("m") / F.greatest(F.col("s"), F.lit(0.001))
    return agg.select(*keys, F.when(centre < 0.5, "left").otherwise("right").alias("side"))


def _celled(df: DataFrame, params: PersistentParams) -> DataFrame:
    """Observations of either side with the cell of their centre and whether they name the brand."""
    sided = df.withColumn("side", F.lower(strip("side"))).where(F.col("side").isin("left", "right"))
    return sided.withColumns({
        "cx": ((F.col("x") + F.col("w") / 2) / params.bucket_x).cast("int"),
        "cy": ((F.col("y") + F.col("h") / 2) / params.bucket_y).cast("int"),
        "branded": F.coalesce(F.contains(F.lower("text"), F.lit(params.brand)), F.lit(False)),
    })


def persistent_region(df: DataFrame, samples: DataFrame, params: PersistentParams = PersistentParams()) -> DataFrame:
    """df(video_id, ord, sample, side, x, y, w, h, text, confidence) and samples(video_id, sample_count): the
    region of text that stays at one side, per video.

    Everything is counted per (video, side, cell, sample) first; later steps work on that small table,
    which is written once.
    """
    points = (
        regions.clamp(F.coalesce(F.col("confidence"), F.lit(0.0)), 0.0, 1.0)
        + F.when(F.rlike("text", F.lit("[A-Za-z0-9]")), 0.25).otherwise(0.0) + F.when(F.col("branded"), 2.75).otherwise(0.0)
    )
    cell = ["video_id", "side", "cx", "cy"]
    left, top, right, bottom = edges()
    per_sample = _celled(df, params).groupBy(*cell, "sample").agg(
        F.sum(points).alias("score"), F.bool_or("branded").alias("brand"), F.min("ord").alias("first_ord"),
        F.min(left).alias("l"), F.min(top).alias("t"), F.max(right).alias("r"), F.max(bottom).alias("b"),
    )
    per_sample = written(per_sample, "cells")
    clusters = per_sample.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("hits"), F.sum("score").alias("score"), F.bool_or("brand").alias("brand"), F.min("first_ord").alias("first_ord"),
        F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"),
    ).where((F.col("hits") >= params.min_hits) | F.col("brand")).join(samples, "video_id").where(F.col("sample_count") > 0)
    gain = F.col("score") * (1.0 + F.col("hits") / F.col("sample_count"))
    per_side = clusters.groupBy("video_id", "side").agg(
        F.sum(gain).alias("gain"), F.first("sample_count").alias("sample_count"),
        F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"),
    )
    # left wins a tie, so it orders as the larger value
    best = F.max(F.struct("gain", (F.col("side") == "left").alias("is_left"), "side", "l", "t", "r", "b"))
    chosen = per_side.groupBy("video_id").agg(best.alias("c"), F.sum("gain").alias("all_gain"), F.first("sample_count").alias("sample_count"))
    chosen = chosen.where(F.col("c.gain") > 0).withColumn("side", F.col("c.side"))
    members = per_sample.join(clusters.select(*cell), cell, "left_semi")
    distinct = members.select("video_id", "side", "sample").distinct().groupBy("video_id", "side").agg(F.count(F.lit(1)).alias("hits"))
    x, y, w, h = F.col("c.l"), F.col("c.t"), F.col("c.r") - F.col("c.l"), F.col("c.b") - F.col("c.t")
    tw = regions.clamp(F.greatest(w + 2 * params.pad_x, F.lit(params.min_w)), params.min_w, params.max_w)
    th = regions.clamp(F.greatest(h + 2 * params.pad_y, F.lit(params.min_h)), params.min_h, params.max_h)
    region = regions.box(regions.clamp(x + w / 2 - tw / 2, F.lit(0.0), 1.0 - tw), regions.clamp(y + h / 2 - th / 2, F.lit(0.0), 1.0 - th), tw, th)
    share = F.col("c.gain") / F.greatest(F.lit(0.001), F.col("all_gain"))
    confidence = regions.clamp(0.55 * F.col("hits") / F.col("sample_count") + 0.45 * share, 0.0, 1.0)
    return chosen.join(distinct, ["video_id", "side"]).select(
        "video_id", "side", "hits", F.bround(confidence, 4).alias("confidence"), regions.rounded(region).alias("region"),
    )


def persistent_texts(df: DataFrame, chosen: DataFrame, params: PersistentParams = PersistentParams()) -> DataFrame:
    """First texts of the persistent cells of each video's chosen side: cells in the order they were first seen."""
    cell = ["video_id", "side", "cx", "cy"]
    rows = _celled(df, params).join(chosen.select("video_id", F.lower(strip("side")).alias("side")), ["video_id", "side"], "left_semi")
    cells = rows.groupBy(*cell).agg(
        F.count_distinct("sample").alias("hits"), F.bool_or("branded").alias("brand"), F.min("ord").alias("first_ord"),
    ).where((F.col("hits") >= params.min_hits) | F.col("brand"))
    mine = rows.where(F.coalesce(F.col("text"), F.lit("")) != "").join(cells.select(*cell, "first_ord"), cell)
    order = Window.partitionBy("video_id").orderBy("first_ord", "ord")
    first = mine.withColumn("n", F.row_number().over(order)).where(F.col("n") <= params.max_texts)
    return first.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s.text).alias("texts"))


_GROUPED = [StructField("item", LongType()), StructField("grp", LongType())]


def _shared(a: tuple, b: tuple, least: float) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h / max(least, min(a[2] * a[3], b[2] * b[3])) if w > 0 and h > 0 else 0.0


class _Grid:
    """Boxes of groups by place: a box lies in the few cells of its size that it covers, a search looks at those it may touch.

    Sizes double from one level to the next, so a box covers at most nine cells of its level. In a cell boxes are
    kept by group, and a search goes through the groups in order and ends with the first that has a box it meets.
    """

    def __init__(self) -> None:
        self.levels: dict[int, dict[tuple[int, int], dict[int, list[tuple]]]] = {}
        self.held: set[tuple[tuple, int]] = set()
        self.boxes = 0

    @staticmethod
    def _range(box: tuple, size: float) -> tuple[int, int, int, int]:
        return floor(box[0] / size), floor((box[0] + box[2]) / size), floor(box[1] / size), floor((box[1] + box[3]) / size)

    def add(self, box: tuple, group: int) -> None:
        if (box, group) in self.held:
            return
        self.held.add((box, group))
        self.boxes += 1
        level = frexp(max(box[2], box[3]))[1]
        left, right, top, bottom = self._range(box, 2.0**level)
        cells = self.levels.setdefault(level, {})
        for cell in product(range(left, right + 1), range(top, bottom + 1)):
            cells.setdefault(cell, {}).setdefault(group, []).append(box)

    def first(self, box: tuple, meets: Callable[[tuple, tuple], bool]) -> int | None:
        """The smallest number of a group with a box that this one meets."""
        near: dict[int, list[list[tuple]]] = {}
        for level, cells in self.levels.items():
            left, right, top, bottom = self._range(box, 2.0**level)
            if (right - left + 1) * (bottom - top + 1) <= len(cells):
                touched = (cells[c] for c in product(range(left, right + 1), range(top, bottom + 1)) if c in cells)
            else:
                touched = (groups for (x, y), groups in cells.items() if left <= x <= right and top <= y <= bottom)
            for groups in touched:
                for group, members in groups.items():
                    near.setdefault(group, []).append(members)
        return next((g for g in sorted(near) if any(meets(box, m) for members in near[g] for m in members)), None)


def _first_group(threshold: float, strict: bool, least: float):
    """Each box goes to the first group one of whose boxes it overlaps enough."""
    def meets(a: tuple, b: tuple) -> bool:
        shared = _shared(a, b, least)
        return shared > threshold if strict else shared >= threshold

    def step(key: tuple, rows: Iterator[tuple]) -> Iterable[tuple]:
        grid, held, groups = _Grid(), {}, 0  # held: the group of each box, and how many boxes there were when it was found
        for item, *shape in rows:
            box = tuple(shape)
            if box[2] <= 0 or box[3] <= 0:  # a box without area overlaps nothing, not even its equal
                hit, groups = groups, groups + 1
            else:
                # Too small a box does not even meet its equal.
                hit, seen = held.get(box, (None, -1)) if meets(box, box) else (None, -1)
                if seen < grid.boxes:  # an earlier group may have grown to here since
                    found = grid.first(box, meets)
                    hit, groups = (groups, groups + 1) if found is None else (found, groups)
                    grid.add(box, hit)
                    held[box] = hit, grid.boxes
            yield (*key, item, hit)
    return step


def overlap_groups(df: DataFrame, keys: list[str], threshold: float = 0.28, strict: bool = False, floor: float = 1e-9) -> DataFrame:
    """df(keys, item, x, y, w, h) with the group number of every box, boxes taken in item order."""
    key_fields = sorted((f for f in df.schema.fields if f.name in keys), key=lambda f: keys.index(f.name))
    schema = StructType(key_fields + _GROUPED)
    grouped = fold(df, keys, ["item"], ["item", "x", "y", "w", "h"], _first_group(threshold, strict, floor), schema)
    return df.join(grouped, [*keys, "item"])


def cleanup_regions(df: DataFrame, keys: list[str], threshold: float = 0.28, pad_x: float = 0.010, pad_y: float = 0.008, limit: int = 10) -> DataFrame:
    """Stable envelopes of boxes seen across frames: padded, by (top, left), the first ten per segment."""
    usable = df.where((F.col("w") > 0.001) & (F.col("h") > 0.001))
    grouped = overlap_groups(usable, keys, threshold)
    left, top, right, bottom = edges()
    env = grouped.groupBy(*keys, "grp").agg(F.min(left).alias("l"), F.min(top).alias("t"), F.max(right).alias("r"), F.max(bottom).alias("b"))
    x, y = F.greatest(F.lit(0.0), F.col("l") - pad_x), F.greatest(F.lit(0.0), F.col("t") - pad_y)
    r, b = F.least(F.lit(1.0), F.col("r") + pad_x), F.least(F.lit(1.0), F.col("b") + pad_y)
    shape = env.select(*keys, "grp", x.alias("x"), y.alias("y"), F.greatest(F.lit(0.001), r - x).alias("w"), F.greatest(F.lit(0.001), b - y).alias("h"))
    order = Window.partitionBy(*keys).orderBy("y", "x", "grp")
    ranked = shape.withColumn("region_no", F.row_number().over(order)).where(F.col("region_no") <= limit)
    return ranked.select(*keys, "region_no", *[F.bround(c, 6).alias(c) for c in "xywh"])


def cluster_detections(df: DataFrame, frames: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """Detections that recur over frames(keys, frame_count): median box, confidence by share of frames."""
    grouped = overlap_groups(df, keys, 0.25, strict=True, floor=1e-6)
    size = grouped.groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("hits"))
    left, top, right, bottom = edges()
    median = grouped.groupBy(*keys, "grp").agg(*[F.percentile(e, 0.5).alias(n) for e, n in ((left, "l"), (top, "t"), (right, "r"), (bottom, "b"))])
    kept = median.join(size, [*keys, "grp"]).join(frames, keys).where(F.col("hits") >= F.greatest(F.lit(2), F.floor(F.col("frame_count") / 5)))
    confidence = F.least(F.lit(0.98), 0.55 + F.col("hits") / F.greatest(F.lit(1), F.col("frame_count")) * 0.35)
    raw = regions.box(F.col("l"), F.col("t"), F.col("r") - F.col("l"), F.col("b") - F.col("t"))
    order = Window.partitionBy(*keys).orderBy("grp")
    ranked = kept.withColumn("cluster", F.row_number().over(order)).where(F.col("cluster") <= limit)
    return ranked.select(*keys, "cluster", "hits", confidence.alias("confidence"), regions.padded(raw, 0.025, 0.025, 0.01).alias("box"))


ZONES = [(0.08, 0.72, 0.74), (0.08, 0.61, 0.63), (0.08, 0.49, 0.49), (0.08, 0.12, 0.12)]  # fixed values: x, y portrait, y landscape
ZONE_W, ZONE_H = 0.84, 0.15


def place_captions(videos: DataFrame, protected: DataFrame, edge_costs: list[str] | None = None) -> DataFrame:
    """videos(video_id, width, height, source_region, source_confidence) and protected(video_id, kind, x, y, w, h):
    where captions go. The penalty of all four zones comes from one aggregate, without pairing zones and regions.
    """
    item = regions.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    factor = F.when(F.col("kind") == "face", 1.8).otherwise(1.0)

    def zone(i: int, upright: Column) -> Column:
        x, tall, wide = ZONES[i]
        return regions.box(F.lit(x), F.when(upright, tall).otherwise(wide), F.lit(ZONE_W), F.lit(ZONE_H))

    both = protected.select(
        "video_id", *[F.struct((regions.overlap(zone(i, F.lit(True)), item, 1e-6) * factor).alias("p"),
                               (regions.overlap(zone(i, F.lit(False)), item, 1e-6) * factor).alias("l")).alias(f"z{i}") for i in range(4)],
    )
    sums = both.groupBy("video_id").agg(*[F.sum(F.col(f"z{i}.{o}")).alias(f"{o}{i}") for i in range(4) for o in "pl"])
    joined = videos.join(sums, "video_id", "left").withColumn("_portrait", F.col("height") >= F.col("width"))
    costs = []
    for i in range(4):
        penalty = F.coalesce(F.when(F.col("_portrait"), F.col(f"p{i}")).otherwise(F.col(f"l{i}")), F.lit(0.0))
        edge = F.coalesce(F.col(edge_costs[i]), F.lit(0.0)) if edge_costs else F.lit(0.0)
        shape = zone(i, F.col("_portrait"))
        costs.append(F.struct((edge + penalty + i * 0.018).alias("cost"), F.lit(i).alias("zone"), (shape.y + shape.h * 0.58).alias("anchor")))
    best = F.least(*costs)
    own = F.col("source_region").isNotNull() & (F.col("source_confidence") >= 0.68)
    kept = regions.clamp(F.col("source_region.y") + F.col("source_region.h") * 0.56, 0.12, 0.90)
    return joined.select(
        "video_id", F.when(own, "replace_source_subtitle").otherwise("lowest_safe_zone").alias("reason"),
        F.when(~own, best.zone).alias("zone"), F.round(F.when(own, kept).otherwise(best.anchor), 5).alias("anchor_y"),
    )
