"""Box expressions on struct columns (x, y, w, h) with values between 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_REGION = (0.06, 0.72, 0.88, 0.18)


def clamp(col: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(as_col(low), F.least(as_col(high), col))


def box(x: Column | float, y: Column | float, w: Column | float, h: Column | float) -> Column:
    as_col = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(as_col(x).alias("x"), as_col(y).alias("y"), as_col(w).alias("w"), as_col(h).alias("h"))


def from_array(values: Column) -> Column:
    """[x, y, w, h] array to box, null when any value is missing."""
    at = lambda i: F.get(values, F.lit(i))
    whole = at(0).isNotNull() & at(1).isNotNull() & at(2).isNotNull() & at(3).isNotNull()
    return F.when(whole, box(at(0), at(1), at(2), at(3)))


def rounded(b: Column, digits: int = 6) -> Column:
    """Half-even rounding of all four values."""
    return box(*[F.bround(b[k], digits) for k in "xywh"])


def padded(b: Column, pad_x: float, pad_y: float, min_size: float = 0.005) -> Column:
    """Grown by the paddings on every side, kept in frame, at least min_size wide and high."""
    x = clamp(b.x - pad_x, 0.0, 1.0 - min_size)
    y = clamp(b.y - pad_y, 0.0, 1.0 - min_size)
    right = clamp(b.x + b.w + pad_x, x + min_size, 1.0)
    bottom = clamp(b.y + b.h + pad_y, y + min_size, 1.0)
    return box(x, y, right - x, bottom - y)


def normalized(b: Column, pad: bool = True, pad_x: float = 0.018, pad_y: float = 0.012,
               fallback: tuple[float, float, float, float] = DEFAULT_REGION) -> Column:
    """In-frame box of at least 2 %, the fallback when null, padded on demand."""
    b = F.coalesce(b, box(*fallback))
    x, y = clamp(b.x, 0.0, 0.98), clamp(b.y, 0.0, 0.98)
    inside = box(x, y, clamp(b.w, 0.02, 1.0 - x), clamp(b.h, 0.02, 1.0 - y))
    return padded(inside, pad_x, pad_y, 0.02) if pad else inside


def grown(b: Column, min_w: float, min_h: float) -> Column:
    """At least min_w x min_h around the same centre, kept in frame."""
    w = clamp(F.greatest(b.w, F.lit(min_w)), 0.02, 0.96)
    h = clamp(F.greatest(b.h, F.lit(min_h)), 0.02, 0.30)
    x = clamp(b.x + b.w / 2 - w / 2, F.lit(0.0), 1.0 - w)
    y = clamp(b.y + b.h / 2 - h / 2, F.lit(0.0), 1.0 - h)
    return box(x, y, w, h)


def overlap(a: Column, b: Column, floor: float = 1e-9) -> Column:
    """Shared area over the smaller of the two areas."""
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    smaller = F.greatest(F.lit(floor), F.least(a.w * a.h, b.w * b.h))
    return F.when((w > 0) & (h > 0), w * h / smaller).otherwise(0.0)


def union_of(boxes: Column) -> Column:
    """Envelope of an array of boxes."""
    edge = lambda pick, f: f(F.transform(boxes, pick))
    left, top = edge(lambda b: b.x, F.array_min), edge(lambda b: b.y, F.array_min)
    right, bottom = edge(lambda b: b.x + b.w, F.array_max), edge(lambda b: b.y + b.h, F.array_max)
    return F.when(F.size(boxes) > 0, box(left, top, F.greatest(F.lit(0.001), right - left), F.greatest(F.lit(0.001), bottom - top)))


def placement(b: Column, threshold: float = 0.68) -> Column:
    return F.when(b.y + b.h >= threshold, "bottom").otherwise("upper")


def detail_boxes(boxes: Column, limit: int = 12, pad_x: float = 0.004, pad_y: float = 0.004) -> Column:
    """First boxes by (top, left), tiny ones dropped, slightly padded."""
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct(b.y.alias("y"), b.x.alias("x"), b.w.alias("w"), b.h.alias("h"))))
    kept = F.filter(F.slice(ordered, 1, limit), lambda b: (b.w > 0.002) & (b.h > 0.002))
    return F.transform(kept, lambda b: rounded(padded(b, pad_x, pad_y)))


def segment_geometry(boxes: Column, limit: int = 12, threshold: float = 0.68) -> Column:
    """Padded details, padded envelope and placement of a segment's boxes; null without boxes."""
    details = F.transform(F.slice(boxes, 1, limit), lambda b: rounded(padded(b, 0.004, 0.004)))
    envelope = padded(union_of(boxes), 0.012, 0.008)
    return F.when(F.size(boxes) > 0, F.struct(
        details.alias("regions"), rounded(envelope).alias("bbox"), placement(envelope, threshold).alias("placement"),
    ))
