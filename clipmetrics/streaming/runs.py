"""Running a stream over what has arrived, with its progress and output in the shared folder."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

from clipmetrics.session import work_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, schema: str, files: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; a backlog is taken in bounded micro-batches."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


@contextmanager
def _state_partitions(spark: SparkSession) -> Iterator[None]:
    """A stream keeps the number of state partitions it started with. On one machine there is no use for
    more of them than cores; a cluster session keeps its own setting."""
    key = "spark.sql.shuffle.partitions"
    before, cores = spark.conf.get(key), spark.sparkContext.defaultParallelism
    if spark.conf.get("spark.master", "").startswith("local") and int(before) > cores:
        spark.conf.set(key, str(cores))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _Dropped(StreamingQueryListener):
    """Rows that stateful operators refused as late, per micro-batch: a few numbers each."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.ended: set[str] = set()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        for place, operator in enumerate(p.stateOperators):
            self.rows.append((str(p.id), p.batchId, place, operator.operatorName, p.eventTime.get("watermark"), p.numInputRows, operator.numRowsDroppedByWatermark))

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.ended.add(str(event.runId))


DROPPED = "query string, batch long, place int, operator string, watermark string, input_rows long, dropped long"


def append_counting_late(stream: DataFrame, name: str, path: str | None = None, wait_seconds: float = 60.0) -> tuple[str, str]:
    """append_available that also keeps a table of the rows each micro-batch dropped as late; returns both folders.

    Spark counts what reaches its stateful operator: rows as they came for keyed state and repeats, groups of equal keys
    within a task for windowed aggregates. The table has one row per micro-batch and stateful operator.
    """
    target = path or work_dir(stream.sparkSession, name)
    spark, heard = stream.sparkSession, _Dropped()
    spark.streams.addListener(heard)
    try:
        with _state_partitions(spark):
            query = _appending(stream, target).start()
        query.awaitTermination()
        deadline = time.monotonic() + wait_seconds
        while str(query.runId) not in heard.ended and time.monotonic() < deadline:
            time.sleep(0.05)  # events arrive in order, shortly after the query's end
    finally:
        spark.streams.removeListener(heard)
    if str(query.runId) not in heard.ended:
        raise RuntimeError("progress events are missing, so late rows cannot be counted")
    own = [r for r in heard.rows if r[0] == str(query.id)]
    spark.createDataFrame(own, DROPPED).coalesce(1).write.mode("append").parquet(f"{target}/late")
    return f"{target}/rows", f"{target}/late"


def _appending(stream: DataFrame, target: str) -> DataStreamWriter:
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{target}/rows")
        .option("checkpointLocation", f"{target}/progress").trigger(availableNow=True)
    )


def append_available(stream: DataFrame, name: str, path: str | None = None) -> str:
    """Process everything that is there and append final rows to Parquet files; returns their folder."""
    target = path or work_dir(stream.sparkSession, name)
    with _state_partitions(stream.sparkSession):
        query = _appending(stream, target).start()
    query.awaitTermination()
    return f"{target}/rows"


def each_available(stream: DataFrame, write: Callable[[DataFrame, int], None], progress: str) -> None:
    """Hand every micro-batch of what is there, with its number, to write."""
    writer = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True)
    with _state_partitions(stream.sparkSession):
        query = writer.start()
    query.awaitTermination()


def changes_available(stream: DataFrame, name: str, path: str | None = None, then: Callable[[SparkSession, str, int], None] | None = None) -> str:
    """Write the keys changed by each micro-batch as a folder of a change log; returns the log's folder.

    Only changed keys are written per batch, never the whole state. A batch repeated after a failure
    overwrites its own folder.
    """
    target = path or work_dir(stream.sparkSession, name)
    log = f"{target}/changes"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        if then:
            then(batch.sparkSession, log, number)

    each_available(stream, write, f"{target}/progress")
    return log


def latest(spark: SparkSession, log: str, keys: list[str]) -> DataFrame:
    """Newest version of every key of a change log."""
    changes = spark.read.option("basePath", log).parquet(log)
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    packed = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return packed.select(*keys, "_row.*")
