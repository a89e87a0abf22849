"""Sequential logic per key as a stream over sorted partitions.

Used only where the next result depends on the one before it (greedy clustering, packing). Spark
partitions by key and sorts; each task then reads its rows as one stream of Arrow batches and keeps only
the state of the current key, so neither a key nor a partition has to fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[[tuple, Iterator[tuple]], Iterable[tuple]]


def fold(df: DataFrame, keys: list[str], order: list[str], values: list[str], step: Step, schema: StructType) -> DataFrame:
    """step(key, rows) yields output tuples; rows are the value columns of one key in the given order."""
    target = to_arrow_schema(schema)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        results = (out for key, group in groupby(rows, key=lambda r: r[:width]) for out in step(key, (r[width:] for r in group)))
        while chunk := list(islice(results, 10_000)):
            columns = list(zip(*chunk))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return (
        df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *values).mapInArrow(run, schema)
    )
