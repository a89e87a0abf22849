"""Streams over several micro-batches end in the batch result."""

from __future__ import annotations

import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from clipmetrics.operators import candidates as batch
from clipmetrics.operators import captions as batch_captions
from clipmetrics.operators import ranking
from clipmetrics.params import CaptionParams
from clipmetrics.plans import adapters, streams
from clipmetrics.streaming import candidates, captions, runs, state, tables

SF = "/root/testdata/sf0.001"
START = 1_700_000_000_000_000  # rows at the epoch itself would be late for the initial watermark


def in_pieces(spark, df, order, pieces=5):
    """The rows as several files whose order follows the given column."""
    folder = tempfile.mkdtemp(prefix="run-stream-")
    sliced = df.withColumn("_p", F.ntile(pieces).over(Window.orderBy(order)))
    for p in range(1, pieces + 1):
        sliced.where(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(folder)
    return folder


def event_hits(spark):
    return adapters.event_hits(spark, SF).withColumn("published_at", F.col("published_at").cast("timestamp"))


def ddl(df):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def test_running_merge_equals_batch(spark):
    hits = event_hits(spark)
    stream = runs.read_stream(spark, in_pieces(spark, hits, "seq"), ddl(hits), files_per_batch=1)
    log = runs.changes_available(candidates.merge_stream(stream), "merge")
    cols = hits.columns
    assert spark.read.option("basePath", log).parquet(log).select("batch").distinct().count() > 2
    assert sorted(map(str, candidates.merged(spark, log).select(cols).collect())) == sorted(map(str, batch.merge_candidates(hits).select(cols).collect()))


def test_bounded_merge(spark):
    hits = event_hits(spark)
    stream = runs.read_stream(spark, in_pieces(spark, hits, "published_at"), ddl(hits), files_per_batch=1)
    rows = spark.read.parquet(runs.append_available(candidates.merge_sessions(stream, "published_at", "6 hours", "1 hour"), "bounded"))
    assert rows.where("seq is null").count() == 0 and 0 < rows.count() < hits.count()
    assert rows.agg(F.max("likes")).first()[0] <= hits.agg(F.max("likes")).first()[0]


def test_restart_continues(spark):
    hits = event_hits(spark)
    folder = in_pieces(spark, hits.where("seq % 4 <> 1"), "seq", 2)
    base = tempfile.mkdtemp(prefix="run-restart-")
    read = lambda: candidates.merge_stream(runs.read_stream(spark, folder, ddl(hits), files_per_batch=1))
    runs.changes_available(read(), "merge", base)
    hits.where("seq % 4 = 1").coalesce(1).write.mode("append").parquet(folder)
    log = runs.changes_available(read(), "merge", base)
    assert sorted(map(str, candidates.merged(spark, log).select(hits.columns).collect())) == sorted(map(str, batch.merge_candidates(hits).select(hits.columns).collect()))


def test_late_rows_do_not_change_final_windows(spark):
    hits = event_hits(spark)
    folder = in_pieces(spark, hits, "published_at", 6)
    stream = lambda: candidates.trend_windows(runs.read_stream(spark, folder, ddl(hits), files_per_batch=1), "published_at", "1 hour")
    base = tempfile.mkdtemp(prefix="run-late-")
    first = spark.read.parquet(runs.append_available(stream(), "w", base)).count()
    hits.where("seq < 60").coalesce(1).write.mode("append").parquet(folder)
    rows = spark.read.parquet(runs.append_available(stream(), "w", base))
    assert rows.count() == first and rows.groupBy("window_start", "platform").count().where("count > 1").count() == 0


def test_repeats_within_the_delay(spark):
    rows = spark.createDataFrame([("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 00:30:00", 2), ("z", "2024-01-01 09:00:00", 3), ("y", "2024-01-01 09:10:00", 4), ("k", "2024-01-01 09:30:00", 5)], "key string, at string, n long").withColumn("at", F.col("at").cast("timestamp"))
    folder = in_pieces(spark, rows, "n", 5)
    stream = candidates.suppress_repeats(runs.read_stream(spark, folder, ddl(rows), files_per_batch=1), "at", "1 hour", ["key"])
    assert sorted(r.n for r in spark.read.parquet(runs.append_available(stream, "d")).collect()) == [1, 3, 4, 5]


def test_caption_sessions(spark):
    rows = spark.createDataFrame([("v", "a b", 0), ("v", "ab", 2), ("v", "ab", 20), ("v", "x", 100)], "video_id string, text string, s long").select("video_id", "text", F.lit(0.5).alias("confidence"), F.timestamp_seconds("s").alias("at"))
    folder = in_pieces(spark, rows, "at", 4)
    out = captions.caption_sessions(runs.read_stream(spark, folder, ddl(rows), files_per_batch=1), "at", "5 seconds", "1 second")
    got = spark.read.parquet(runs.append_available(out, "s")).select("text", "observation_count", F.unix_seconds("end_time").alias("e"))
    assert sorted((r.text, r.observation_count, r.e) for r in got.collect()) == [("ab", 1, 25), ("ab", 2, 7)]


def test_cache_over_batches(spark):
    minute = 60_000_000
    rows = spark.createDataFrame([("k", 0, 1, True), ("k", 29 * minute, 2, True), ("k", 31 * minute, 3, False), ("k", 33 * minute, 4, True), ("k", 35 * minute, 5, True), ("q", 500 * minute, 6, True), ("k", 501 * minute, 7, True)],
                                 "key string, at_us long, request long, found boolean").withColumn("at_us", F.col("at_us") + START).withColumn("at", F.timestamp_micros("at_us"))
    folder = in_pieces(spark, rows, "request", 7)
    out = state.preview_cache(runs.read_stream(spark, folder, ddl(rows), files_per_batch=1), "at", "1 minute")
    got = {r.request: r.outcome for r in spark.read.parquet(runs.append_available(out, "c")).collect()}
    assert got == {1: "fetched", 2: "cached", 3: "fetched", 4: "cached", 5: "fetched", 6: "fetched", 7: "fetched"}


def test_job_monitor_over_batches(spark):
    minute = 60_000_000
    rows = spark.createDataFrame([("a", 1, 0, "queued"), ("a", 3, 10 * minute, "rendering"), ("a", 2, 5 * minute, "downloading"), ("b", 4, 20 * minute, "queued"), ("b", 5, 30 * minute, "done"), ("c", 6, 400 * minute, "queued"), ("d", 7, 401 * minute, "done")],
                                 "job_id string, seq long, at_us long, status string").withColumn("at_us", F.col("at_us") + START).withColumn("at", F.timestamp_micros("at_us"))
    folder = in_pieces(spark, rows, "seq", 7)
    log = runs.changes_available(state.job_monitor(runs.read_stream(spark, folder, ddl(rows), files_per_batch=1), "at", "10 minutes"), "m")
    got = {(r.job_id, r.interrupted): (r.status, r.attempts) for r in runs.latest(spark, log, ["job_id", "interrupted"]).collect()}
    assert got == {("a", False): ("rendering", 1), ("a", True): ("rendering", 1), ("b", False): ("done", 1), ("c", False): ("queued", 1), ("d", False): ("done", 0)}


def test_snapshot_follows_batches(spark):
    out = streams.st_rank_snapshot(spark, SF)
    assert 0 < out.count() <= 30


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_runs_of_a_table_cover_every_batch_once(fan_in):
    table = tables.RunTable("t", lambda rows: rows, fan_in)
    for batches in range(1, 200):
        covered = []
        for path in table.live(batches):
            level, number = (int(part.split("=")[1]) for part in path.split("/")[1:])
            covered += range(number * fan_in**level, (number + 1) * fan_in**level)
        assert covered == list(range(batches))


def _rows(df):
    return sorted(map(str, df.collect()))


def test_candidate_table_takes_hits_in_any_order_and_again(spark):
    hits = event_hits(spark)
    folder = in_pieces(spark, hits, F.xxhash64("seq"), 10)
    parts = candidates.merge_parts(runs.read_stream(spark, folder, ddl(hits), files_per_batch=1))
    sizes = []
    count = lambda session, table, number: sizes.append(len(list(Path(table.path).glob("level=*/run=*"))))
    table = tables.table_available(parts, "merge", candidates.merge_of_parts, fan_in=3, then=count)
    cols, want = hits.columns, _rows(batch.merge_candidates(hits).select(hits.columns))
    assert table.batches(spark) == 10 and max(sizes) <= 9 and len(table.live(10)) == 2
    assert _rows(candidates.from_parts(table.read(spark)).select(cols)) == want
    # A batch that comes again, as after a failure, and one whose rows all came before change nothing.
    first = candidates.merge_parts(spark.read.schema(ddl(hits)).parquet(folder)).where("seq % 3 = 1").withColumn("batch", F.lit(9).cast("long"))
    table.add(first, 10)
    table.add(first, 10)
    assert table.batches(spark) == 11 and _rows(candidates.from_parts(table.read(spark)).select(cols)) == want


def test_a_batch_costs_its_own_rows(spark):
    """No combination reads more than fan_in runs, and runs that were combined go."""
    read = []

    def combine(rows):
        read.append(len({f.rsplit('/', 1)[0] for f in rows.inputFiles()}))
        return rows.groupBy("job_id").agg(F.max("seq").alias("seq"))

    base = tempfile.mkdtemp(prefix="run-cost-")
    table = tables.RunTable(f"{base}/table", combine, 4)
    for n in range(34):
        table.add(spark.range(n * 5, n * 5 + 5).select((F.col("id") % 40).alias("job_id"), F.col("id").alias("seq")), n)
    assert max(read) <= 4 and len(list(Path(table.path).glob("level=*/run=*"))) <= 4 * 3 and len(list(Path(table.path).glob("head/[0-9]*"))) == 1
    assert sorted(map(tuple, table.read(spark).collect())) == [(k, 130 + (k - 130) % 40) for k in range(40)]
    with pytest.raises(ValueError):
        tables.RunTable(f"{base}/none", combine).read(spark)


def test_snapshot_of_changes_equals_a_whole_ranking(spark):
    hits = event_hits(spark)
    folder = in_pieces(spark, hits, F.xxhash64("seq"), 8)
    query, now = F.lit(streams.QUERY), adapters.now()
    top = tables.TopSnapshot(tempfile.mkdtemp(prefix="run-top-"), candidates.MERGE_KEYS, query, now, 5)
    whole = []

    def then(session, table, number):
        top.update(session, table, number)
        want = ranking.top(ranking.score(table.read(session), query, now), "overall", 5).select(*streams.SCORE_COLUMNS)
        assert list(map(tuple, top.read(session, number).select(*streams.SCORE_COLUMNS).collect())) == list(map(tuple, want.collect()))
        whole.append(top.read(session, number).first().whole)

    stream = candidates.merge_stream(runs.read_stream(spark, folder, ddl(hits), files_per_batch=1))
    tables.table_available(stream, "merged", tables.newest(candidates.MERGE_KEYS, "batch"), fan_in=3, then=then)
    assert whole[0] and not all(whole) and len(whole) >= 6


OBSERVED = "video_id string, ord long, t double, text string, confidence double"
SHORT = CaptionParams(interval=1.0, max_gap=5.0, slice_seconds=30.0)


def observed(seed, videos=4, rows=120):
    draw, base, out = random.Random(seed), START / 1e6, []
    for v in range(videos):
        t, word = base, "今天天气很好啊"
        for n in range(rows):
            t += draw.choice([0.0, 0.5, 1.0, 1.0, 2.0, 5.0, 5.5, 9.0])
            if draw.random() < 0.3:
                word = draw.choice(["今天天气很好啊", "今天天气很好", "今天天氣很好啊", "明天天气不好", "hello there", "hello where", "..", "ok then"])
            out.append((f"v{v}", v * rows + n, t, word, round(draw.uniform(0.3, 1.0), 3)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_as_a_stream_equal_the_batch(spark, seed):
    rows = observed(seed)
    draw = random.Random(seed)
    end = max(r[2] for r in rows)
    df = spark.createDataFrame([(*r, r[2] + draw.uniform(0, 15)) for r in rows] + [("end", 10**6, end + 1000, "the end", 0.9, end + 1000)],
                               OBSERVED + ", came double").withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    folder = in_pieces(spark, df, "came", 7)
    base = tempfile.mkdtemp(prefix="run-seg-")

    def run():
        stream = batch_captions.accept(runs.read_stream(spark, folder, ddl(df), files_per_batch=1), SHORT)
        return runs.append_counting_late(captions.segment_stream(stream, "at", "20 seconds", SHORT), "s", base)

    digits = lambda out: sorted((r.video_id, r.start_s, r.end_s, r.text, round(r.confidence, 9), r.observation_count) for r in out.collect() if r.video_id != "end")
    kept, late = run()
    accepted = batch_captions.accept(df.select("video_id", "ord", "t", "text", "confidence"), SHORT)
    want = digits(batch_captions.segment_rows(batch_captions.similar_text_segments(accepted, SHORT), SHORT))
    assert digits(spark.read.parquet(kept)) == want and len(want) > 20
    assert spark.read.parquet(late).agg(F.sum("dropped")).first()[0] == 0
    df.where("video_id = 'v1'").limit(3).withColumn("confidence", F.lit(0.9)).withColumn("text", F.lit("too late")).coalesce(1).write.mode("append").parquet(folder)
    kept, late = run()
    assert digits(spark.read.parquet(kept)) == want
    assert spark.read.parquet(late).agg(F.sum("dropped")).first()[0] == 3


def test_job_monitor_takes_rows():
    """Rows of one job in any order, without a frame, and one question to the state."""
    asked, timers = [], []

    class Job:
        held = None

        def get(self):
            asked.append(1)
            return self.held

        def update(self, value):
            self.held = value

    monitor = state.JobMonitor()
    monitor.job, monitor.handle = Job(), type("Handle", (), {"registerTimer": lambda self, at: timers.append(at)})()
    rows = [Row(job_id="a", seq=s, at_us=at, status=status) for s, at, status in [(2, 9_000, "done"), (1, 5_000, "queued"), (3, 9_000, "queued")]]
    out = list(monitor.handleInputRows(("a",), iter(rows), None))
    assert [tuple(r) for r in out] == [("a", 3, "queued", 2, 9_000, False)] and len(asked) == 1 and len(timers) == 1
    out = list(monitor.handleInputRows(("a",), iter(rows[:1]), None))
    assert [tuple(r) for r in out] == [("a", 3, "queued", 2, 9_000, False)]
