"""Segments by similarity to a text that changes along the way, over slices of time.

The text that stands for a segment is always that of one run, so what one slice hands to the next is the number of a run.
A slice that holds a gap hands on the same whatever came before it; every other slice is a function from the run that
enters it to the run that leaves it. These functions are not tabulated but asked: a walk over the slices of a video, a few
rows each, follows the answers known so far, guesses the others and asks for all of them at once. Every round settles at
least the first open slice of each video, and all slices behind right guesses with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from clipmetrics.operators.folds import fold
from clipmetrics.session import written

Close = Callable[[str, str, float], float]
SLICE = "slice"
_KEYS = [StructField("video_id", StringType()), StructField(SLICE, LongType())]
_STATE = [StructField("shown_run", LongType()), StructField("shown", StringType()), StructField("trust", DoubleType()), StructField("began", LongType())]
_ANSWER = StructType([
    *_KEYS, StructField("entry", LongType()), StructField("first_island", LongType()), StructField("last_island", LongType()),
    StructField("most", DoubleType()), StructField("broken", BooleanType()), *_STATE,
])
_ENTRY = StructType([*_KEYS, *_STATE, StructField("settled", BooleanType())])
_PART = StructType([StructField("video_id", StringType()), StructField("island", LongType()), StructField("run", LongType()), StructField("part", LongType())])


class Shown(NamedTuple):
    """The run whose text stands for the open segment, and the run the segment began with (null: before the slice)."""

    run: int
    cmp: str
    trust: float
    began: int | None


def _next(close: Close, threshold: float, shown: Shown | None, run: int, cmp: str, best: float) -> Shown:
    if shown is None or close(shown.cmp, cmp, threshold) < threshold:
        return Shown(run, cmp, round(best, 4), run)
    return Shown(run, cmp, max(shown.trust, round(best, 4)), shown.began) if best > shown.trust else shown


def _alone(close: Close, threshold: float):
    """What a slice hands on when a segment begins with its first run."""
    def step(key: tuple, rows: Iterator[tuple]) -> Iterable[tuple]:
        shown, first, last, most, began = None, None, None, float("-inf"), None
        for island, run, cmp, best in rows:
            shown = _next(close, threshold, shown if island == last else None, run, cmp, best)
            first, last, most = island if first is None else first, island, max(most, best)
            began = run if began is None else began
        yield (*key, None, first, last, most, shown.began != began, *shown)
    return step


def _asked(close: Close, threshold: float):
    """What a slice without a gap hands on when a given run enters it."""
    def step(key: tuple, rows: Iterator[tuple]) -> Iterable[tuple]:
        shown = entry = None
        for run, cmp, best, *entering in rows:
            if entry is None:
                entry = entering[0]
                shown = Shown(*entering, None)
            shown = _next(close, threshold, shown, run, cmp, best)
        yield (*key, entry, None, None, None, None, *shown)
    return step


def _walk(close: Close, threshold: float):
    """The run that enters each slice, and whether what that slice makes of it is known."""
    def leaving(entering: Shown, alone: Shown, most: float, broken: bool, answers: list[tuple]) -> tuple[Shown, bool]:
        for entry, *state in answers:
            if entry == entering.run:
                return Shown(*state), True
        # Guesses: a text that nothing in the slice outdoes stays; else the slice ends as it did when last asked.
        if not broken and entering.trust >= most and close(entering.cmp, alone.cmp, threshold) >= threshold:
            return entering, False
        last = Shown(*answers[-1][1:]) if answers else alone
        return (last if broken else last._replace(began=None)), False

    def step(key: tuple, rows: Iterator[tuple]) -> Iterable[tuple]:
        shown, island = None, None
        for number, group in groupby(rows, key=lambda r: r[0]):
            (_, _, first, last, most, broken, *state), *asked = group
            alone = Shown(*state)
            if first != island:
                shown = alone
            elif first != last:
                yield (*key, number, *shown, True)
                shown = alone
            else:
                after, known = leaving(shown, alone, most, broken, [(a[1], *a[6:]) for a in asked])
                yield (*key, number, *shown, known)
                shown = after if after.began is not None else after._replace(began=shown.began)
            island = last
    return step


def _parts(close: Close, threshold: float):
    def step(key: tuple, rows: Iterator[tuple]) -> Iterable[tuple]:
        shown, before = None, None
        for at, (island, run, cmp, best, *entering) in enumerate(rows):
            if at == 0 and entering[0] is not None:
                shown, before = Shown(*entering), island
            shown = _next(close, threshold, shown if island == before else None, run, cmp, best)
            before = island
            yield key[0], island, run, shown.began
    return step


def segment_parts(runs: DataFrame, close: Close, threshold: float, width: float) -> DataFrame:
    """runs(video_id, island, run, t, cmp, best) to video_id, island, run and part, the run its segment began with.

    run numbers ascend with time in a video; island numbers its stretches without a gap, which end a segment. A run
    joins the open segment when its text is close to the one shown, and is shown from then on if it is more trusted. Slices
    of `width` seconds fold in parallel, also those of one video that never pauses. The rounds are jobs of this call; a video
    whose slices all hold a gap needs none.
    """
    rows = written(runs.select(F.col("video_id").cast("string").alias("video_id"), F.floor(F.col("t") / width).cast("long").alias(SLICE),
                               "island", "run", "cmp", "best"), "runs-sliced")
    keys, values = ["video_id", SLICE], ["run", "cmp", "best"]
    entering = ["shown_run", "shown", "trust"]
    answers = written(fold(rows, keys, ["run"], ["island", *values], _alone(close, threshold), _ANSWER), "slices-alone")
    while True:
        said = [f.name for f in _ANSWER.fields if f.name != "video_id"]
        entries = written(fold(answers, ["video_id"], [SLICE, "entry"], said, _walk(close, threshold), _ENTRY), "slice-entries")
        open_ = entries.where(~F.col("settled")).select(*keys, *entering)
        if open_.isEmpty():
            break
        answer = fold(rows.join(open_, keys), keys, ["run"], [*values, *entering], _asked(close, threshold), _ANSWER)
        answers = answers.unionByName(written(answer, "slices-asked"))
    ready = rows.join(entries, keys, "left")
    return fold(ready, keys, ["run"], ["island", *values, *entering, "began"], _parts(close, threshold), _PART)
