"""Caption runs and segments from an observation stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clipmetrics.functions import similarity, text
from clipmetrics.params import CaptionParams
from clipmetrics.streaming.state import with_state

Ratio = Callable[[str, str], float]


def caption_sessions(observations: DataFrame, event_time: str, gap: str, delay: str) -> DataFrame:
    """Stretches in which a video shows one text with pauses shorter than gap; final past the watermark.

    Interleaved texts make overlapping stretches here, unlike the batch segmentation.
    """
    marked = observations.withWatermark(event_time, delay).withColumn("text", text.squeeze(F.col("text")))
    sessions = marked.groupBy(F.session_window(event_time, gap).alias("s"), "video_id", "text").agg(
        F.count(F.lit(1)).alias("observation_count"), F.max("confidence").alias("confidence"),
    )
    return sessions.select("video_id", "text", F.col("s.start").alias("start_time"), F.col("s.end").alias("end_time"), "observation_count", "confidence")


OPEN = ("start_s double, last_s double, last_us long, text string, sure double, sure_ord long, total double, n long, "
        "shown string, trust double, run string, run_best double")
WAITING = "us long, t double, ord long, text string, cmp string, confidence double"
SEGMENTS = "video_id string, start_s double, end_s double, text string, confidence double, observation_count long"


class _Open(NamedTuple):
    """The open segment of a video, the text shown for it, and the run of equal text it is in.

    trust is null as long as the segment consists of its first run.
    """

    start_s: float
    last_s: float
    last_us: int
    text: str
    sure: float
    sure_ord: int
    total: float
    n: int
    shown: str
    trust: float | None
    run: str
    run_best: float


class Segmenter(StatefulProcessor):
    """The batch segmentation by similar text, on rows put in order by waiting for the watermark.

    Rows of a video wait in the state until none before them can come; then they continue its open segment. The state is
    what arrived within the delay and one open segment, however long the video.
    """

    def __init__(self, params: CaptionParams, ratio: Ratio) -> None:
        self.params, self.close_to = params, similarity.floored(ratio)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            fresh = list(zip(*(frame[c].tolist() for c in ("us", "t", "ord", "text", "cmp", "confidence"))))
            self.waiting.appendList(fresh)
            first = min(r[0] for r in fresh) if first is None else min(first, *(r[0] for r in fresh))
        if first is not None:
            self.handle.registerTimer(_after(first))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[0] <= passed), key=lambda r: (r[1], r[2]))
        later = [r for r in rows if r[0] > passed]
        open_ = _Open(*self.open.get()) if self.open.exists() else None
        done = []
        for row in ready:
            ended, open_ = self._take(open_, row)
            if ended:
                done.append(ended)
        quiet = round(self.params.gap * 1e6)
        if open_ and open_.last_us + quiet < passed:
            done.append(open_)
            open_ = None
        if later:
            self.waiting.put([tuple(r) for r in later])
            self.handle.registerTimer(_after(min(r[0] for r in later)))
        elif rows:
            self.waiting.clear()
        if open_:
            self.open.update(tuple(open_))
            self.handle.registerTimer(_after(open_.last_us + quiet) + 1)
        elif self.open.exists():
            self.open.clear()
        if done:
            yield pd.DataFrame({
                "video_id": key[0], "start_s": [s.start_s for s in done], "end_s": [s.last_s + self.params.interval for s in done],
                "text": [s.text for s in done], "confidence": [s.total / s.n for s in done], "observation_count": [s.n for s in done]})

    def _take(self, open_: _Open | None, row: tuple) -> tuple[_Open | None, _Open]:
        """The segment that the row ends, if it ends one, and the one it belongs to."""
        us, t, at, value, cmp, sure = row
        if open_ and t - open_.last_s <= self.params.gap:
            if cmp != open_.run or cmp == "":
                open_ = self._run_ended(open_)
                joins = self.close_to(open_.shown, cmp, self.params.text_similarity) >= self.params.text_similarity
                open_ = open_._replace(run=cmp, run_best=sure)
            else:
                joins, open_ = True, open_._replace(run_best=max(open_.run_best, sure))
            if joins:
                better = (sure, -at) > (open_.sure, -open_.sure_ord)
                spelling = {"text": value, "sure": sure, "sure_ord": at} if better else {}
                return None, open_._replace(last_s=t, last_us=max(us, open_.last_us), total=open_.total + sure, n=open_.n + 1, **spelling)
        return open_, _Open(t, t, us, value, sure, at, sure, 1, cmp, None, cmp, sure)

    @staticmethod
    def _run_ended(open_: _Open) -> _Open:
        """A run more trusted than what is shown is shown from now on."""
        best = round(open_.run_best, 4)
        if open_.trust is None:
            return open_._replace(shown=open_.run, trust=best)
        return open_._replace(shown=open_.run, trust=max(open_.trust, best)) if open_.run_best > open_.trust else open_

    def close(self) -> None:
        pass


def _after(us: int) -> int:
    """First millisecond at which the watermark has passed this moment."""
    return -(-us // 1000)


def segment_stream(observations: DataFrame, event_time: str, delay: str, params: CaptionParams = CaptionParams(),
                   ratio: Ratio = similarity.ratio) -> DataFrame:
    """observations(video_id, ord, t, text, confidence, <event_time>): segments as in the batch form, once they are over.

    Equal to captions.segment_rows of similar_text_segments on all rows that arrive within the delay, in whatever order;
    later ones are dropped, and counted by runs.append_counting_late. Event time and t must run alike inside a video.
    Rows without video, time, text or confidence are left out.
    """
    marked = observations.withWatermark(event_time, delay)
    rows = marked.select(
        F.col("video_id").cast("string").alias("video_id"), F.unix_micros(F.col(event_time)).alias("us"), F.col("t").cast("double").alias("t"),
        F.col("ord").cast("long").alias("ord"), "text", text.comparable(F.col("text")).alias("cmp"), F.col("confidence").cast("double").alias("confidence"), event_time,
    ).dropna(subset=["video_id", "us", "t", "ord", "text", "confidence"])
    return with_state(rows, "video_id", Segmenter(params, ratio), SEGMENTS, "append")
