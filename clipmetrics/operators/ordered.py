"""Ordered logic over long keys without one task per key.

A key (a video, a job) may hold a large share of all rows, so no window here runs over a whole key.
Rows are cut into slices (key, slice), windows run inside a slice, and what a slice needs to know about
the slices before it comes from a small summary table with one row per (key, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"


def with_slices(df: DataFrame, position: Column, width: float) -> DataFrame:
    """Slice number from a numeric position (seconds, row order): floor(position / width)."""
    return df.withColumn(SLICE, F.floor(position / F.lit(float(width))).cast("long"))


def carry(df: DataFrame, keys: list[str], totals: dict[str, tuple[Column, str]]) -> DataFrame:
    """Add what earlier slices of the same key amount to.

    totals maps a new column to (aggregate over one slice, how): how is sum, max or last. The
    aggregates are combined map-side, so the summary has one row per (key, slice) and the window over
    it is short; joining it back moves only the summary, rows stay where the slice window needs them.
    """
    summary = df.groupBy(*keys, SLICE).agg(*[agg.alias(name) for name, (agg, _) in totals.items()])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    combine = {
        "sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)),
        "max": lambda c: F.max(c).over(before),
        "last": lambda c: F.last(c, ignorenulls=True).over(before),
    }
    carried = summary.select(*keys, SLICE, *[combine[how](F.col(name)).alias(name) for name, (_, how) in totals.items()])
    return df.join(carried, [*keys, SLICE], "left")


def _local(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """prev_<column> from the row before in the whole key (null on the first row)."""
    row = F.struct(*columns)
    carried = carry(df, keys, {"_last": (F.max_by(row, F.struct(*order)), "last")})
    before = F.coalesce(F.lag(row).over(_local(keys, order)), F.col("_last"))
    with_prev = carried.withColumn("_prev", before)
    return with_prev.withColumns({f"prev_{c}": F.col("_prev")[c] for c in columns}).drop("_prev", "_last")


def previous_within(df: DataFrame, keys: list[str], order: list[str], columns: list[str], position: Column,
                    width: float, reach: float) -> DataFrame:
    """prev_<column> from the row before, when it is at most reach away; null otherwise. Adds the slice column.

    Rows near the end of a slice are also sent to the next one, so a single shuffle is enough.
    """
    own = F.floor(position / F.lit(float(width)))
    last = F.floor((position + F.lit(float(reach))) / F.lit(float(width)))
    placed = df.withColumn("_own", own).withColumn(SLICE, F.explode(F.sequence(own, last)))
    row = F.lag(F.struct(*columns)).over(_local(keys, order))
    linked = placed.withColumn("_prev", row).where(F.col(SLICE) == F.col("_own"))
    return linked.withColumns({f"prev_{c}": F.col("_prev")[c] for c in columns}).drop("_prev", "_own")


def running_max(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Largest value over all earlier rows of the key (null on the first row)."""
    carried = carry(df, keys, {"_top": (F.max(value), "max")})
    inside = F.max(value).over(_local(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return carried.withColumn(name, F.greatest(inside, F.col("_top"))).drop("_top")


def running_counts(df: DataFrame, keys: list[str], order: list[str], flags: dict[str, Column]) -> DataFrame:
    """Per flag: number of flagged rows of the key up to and including this row."""
    flagged = df.withColumns({f"_f_{n}": flag.cast("long") for n, flag in flags.items()})
    carried = carry(flagged, keys, {f"_b_{n}": (F.sum(f"_f_{n}"), "sum") for n in flags})
    upto = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    counted = carried.withColumns({n: F.col(f"_b_{n}") + F.sum(f"_f_{n}").over(upto) for n in flags})
    return counted.drop(*[f"_f_{n}" for n in flags], *[f"_b_{n}" for n in flags])


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Dense 1-based position of every row within its key."""
    carried = carry(df, keys, {"_base": (F.count(F.lit(1)), "sum")})
    return carried.withColumn(name, F.col("_base") + F.row_number().over(_local(keys, order))).drop("_base")


def dense_ids(df: DataFrame, keys: list[str], order: list[str], name: str, position: Column, width: float) -> DataFrame:
    """0-based dense numbering after rows were dropped."""
    numbered = row_numbers(with_slices(df, position, width), keys, order, name)
    return numbered.withColumn(name, F.col(name) - 1).drop(SLICE)
