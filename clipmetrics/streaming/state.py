"""Keyed state with timers: a preview cache and a job monitor."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clipmetrics import rules
from clipmetrics.streaming.runs import ROCKSDB

HIT_SECONDS, ERROR_SECONDS = 30 * 60, 3 * 60
KEEP_DAYS = 30
CACHE_OUT = "key string, at_us long, request long, outcome string, expires_us long"
MONITOR_OUT = "job_id string, seq long, status string, attempts long, at_us long, interrupted boolean"


class PreviewCache(StatefulProcessor):
    """Answers repeated requests from the stored entry until it expires: 30 minutes for a hit, 3 for an error."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "expires_us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Requests of one key in a micro-batch, in time order; the batch size bounds them."""
        requests = pd.concat(list(rows)).sort_values(["at_us", "request"])
        expires = self.entry.get()[0] if self.entry.exists() else None
        outcomes, ends = [], []
        for at, found in zip(requests["at_us"].tolist(), requests["found"].tolist()):
            cached = expires is not None and at <= expires
            if not cached:
                expires = at + (HIT_SECONDS if found else ERROR_SECONDS) * 1_000_000
            outcomes.append("cached" if cached else "fetched")
            ends.append(expires)
        self.entry.update((expires,))
        self.handle.registerTimer(expires // 1000 + 1)
        yield pd.DataFrame({"key": key[0], "at_us": requests["at_us"], "request": requests["request"], "outcome": outcomes, "expires_us": ends})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # An entry refreshed since this timer was set has a later timer of its own.
        if self.entry.exists() and self.entry.get()[0] // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


class JobMonitor(StatefulProcessor):
    """Latest status per job whatever the arrival order; running jobs silent for too long are reported.

    A job that has ended leaves the state after KEEP_DAYS of event time; one that starts again later counts its
    attempts anew.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "at_us long, seq long, status string, attempts long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at, seq, status, attempts = self.job.get() or (-1, -1, None, 0)
        for row in rows:
            attempts += row["status"] == "queued"
            if (row["at_us"], row["seq"]) > (at, seq):
                at, seq, status = row["at_us"], row["seq"], str(row["status"])
        self.job.update((at, seq, status, attempts))
        self.handle.registerTimer(self._due(at, status))
        yield Row(job_id=key[0], seq=seq, status=status, attempts=attempts, at_us=at, interrupted=False)

    @staticmethod
    def _due(at_us: int, status: str | None) -> int:
        """When, in milliseconds, a job of this status is reported or forgotten."""
        return at_us // 1000 + (rules.JOB_TIMEOUT_MINUTES * 60_000 if status in rules.RUNNING else KEEP_DAYS * 86_400_000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        known = self.job.get()
        if known is None:
            return
        at, seq, status, attempts = known
        if self._due(at, status) > expiredTimerInfo.getExpiryTimeInMs():
            return  # the job has moved on since, and has a later timer
        if status not in rules.RUNNING or self._due(at, None) <= expiredTimerInfo.getExpiryTimeInMs():
            self.job.clear()
        else:
            self.handle.registerTimer(self._due(at, None))  # silent for good: it leaves the state like an ended one
            yield Row(job_id=key[0], seq=seq, status=status, attempts=attempts, at_us=at, interrupted=True)

    def close(self) -> None:
        pass


def with_state(stream: DataFrame, key: str, processor: StatefulProcessor, output: str, mode: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(key).transformWithStateInPandas(processor, output, mode, "EventTime")


def preview_cache(requests: DataFrame, event_time: str, delay: str) -> DataFrame:
    """requests(key, at_us, request, found, <event_time>): outcome of every request and the end of its entry."""
    return with_state(requests.withWatermark(event_time, delay), "key", PreviewCache(), CACHE_OUT, "append")


def job_monitor(events: DataFrame, event_time: str, delay: str) -> DataFrame:
    """events(job_id, seq, at_us, status, <event_time>): a row per changed job and per interruption found."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Rows, not frames: most jobs have one or a few changes, for which a frame costs more than the work.
    return events.withWatermark(event_time, delay).groupBy("job_id").transformWithState(JobMonitor(), MONITOR_OUT, "update", "EventTime")
