"""Tables that a stream keeps up to date, at a cost per micro-batch that follows the batch and not the table.

A micro-batch writes its own changes as one run. Whenever fan_in runs of a level are there, they are combined to one run of
the next level, so a row is rewritten once per level and a reader meets fewer than fan_in runs of each. Which runs make up
the table follows from the number of batches alone. combine must not mind rows it has seen: a batch repeated after a
failure writes the same runs again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmetrics.operators import ranking
from clipmetrics.session import work_dir
from clipmetrics.streaming.runs import each_available

Combine = Callable[[DataFrame], DataFrame]


def _folder(spark: SparkSession, path: str) -> tuple:
    """File system and path as Hadoop sees them, so that any shared store will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class RunTable:
    """One row per key under `path`; combine(rows) brings rows of the table's schema to one row per key."""

    def __init__(self, path: str, combine: Combine, fan_in: int = 8) -> None:
        if fan_in < 2:
            raise ValueError("fan_in must be at least 2")
        self.path, self.combine, self.fan_in = path, combine, fan_in

    def run(self, level: int, number: int) -> str:
        return f"{self.path}/level={level}/run={number}"

    def live(self, batches: int) -> list[str]:
        """Runs that make up the table after so many batches: the digits of that number, largest level first."""
        paths, level = [], 0
        while batches:
            batches, open_ = divmod(batches, self.fan_in)
            paths = [self.run(level, batches * self.fan_in + i) for i in range(open_)] + paths
            level += 1
        return paths

    def _merged(self, batches: int) -> list[tuple[int, int]]:
        """(level, number) of the runs that the last of so many batches completed."""
        made, level = [], 1
        while batches and batches % self.fan_in == 0:
            batches //= self.fan_in
            made.append((level, batches - 1))
            level += 1
        return made

    def _parts(self, level: int, number: int) -> list[str]:
        return [self.run(level - 1, number * self.fan_in + i) for i in range(self.fan_in)]

    def add(self, changes: DataFrame, number: int) -> None:
        """Write the changes of micro-batch `number` (from 0, without gaps) and combine what is complete.

        Runs go only when the batch after the one that combined them begins, so a repeated batch finds its input and a
        reader that began before keeps its files for one batch.
        """
        spark = changes.sparkSession
        for level, made in self._merged(number):
            for path in self._parts(level, made):
                files, at = _folder(spark, path)
                files.delete(at, True)
        self.combine(changes).write.mode("overwrite").parquet(self.run(0, number))
        for level, made in self._merged(number + 1):
            self.combine(spark.read.parquet(*self._parts(level, made))).write.mode("overwrite").parquet(self.run(level, made))
        self._head(spark, number + 1)

    def _head(self, spark: SparkSession, batches: int) -> None:
        """The number of finished batches is the name of an empty file; older ones go afterwards."""
        files, at = _folder(spark, f"{self.path}/head/{batches}")
        files.create(at, True).close()
        for status in files.listStatus(at.getParent()):
            if int(status.getPath().getName()) < batches:
                files.delete(status.getPath(), False)

    def batches(self, spark: SparkSession) -> int:
        files, at = _folder(spark, f"{self.path}/head")
        return max((int(s.getPath().getName()) for s in files.listStatus(at)), default=0) if files.exists(at) else 0

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as of the last finished batch; a table no batch was written to has no columns and is refused."""
        batches = self.batches(spark)
        if not batches:
            raise ValueError(f"nothing has been written to {self.path}")
        return self.combine(spark.read.parquet(*self.live(batches)))

    def changed(self, spark: SparkSession, number: int) -> DataFrame:
        """What micro-batch `number` wrote, while it is the newest."""
        return spark.read.parquet(self.run(0, number))


def newest(keys: list[str], order: str) -> Combine:
    """The row with the largest order stays, for tables whose rows replace each other."""
    def combine(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
        return packed.select(*keys, "_row.*").select(*rows.columns)

    return combine


def table_available(stream: DataFrame, name: str, combine: Combine, path: str | None = None, fan_in: int = 8,
                    then: Callable[[SparkSession, RunTable, int], None] | None = None) -> RunTable:
    """Bring everything that is there into the table. Rows of stateful streams carry the number of their batch in `batch`."""
    target = path or work_dir(stream.sparkSession, name)
    table = RunTable(f"{target}/table", combine, fan_in)

    def write(batch: DataFrame, number: int) -> None:
        table.add(batch.withColumn("batch", F.lit(number).cast("long")), number)
        if then:
            then(batch.sparkSession, table, number)

    each_available(stream, write, f"{target}/progress")
    return table


class TopSnapshot:
    """The first rows of a ranking after every micro-batch, from the rows that changed and the snapshot before.

    Kept are the ranked rows and those that hold the two maxima scores are normalised by. The table is ranked as a whole only
    when a maximum moved, or when the last place fell, so that a row outside might now be ahead; any other row outside has
    kept its score and its place behind the last one. now is fixed for the life of a snapshot, as every score depends on it.
    Where rows come in order of publication, each batch may bring the fastest riser yet, and then each ranks the table.
    """

    def __init__(self, path: str, keys: list[str], query: Column, now: Column, limit: int = 30) -> None:
        self.path, self.keys, self.query, self.now, self.limit = path, keys, query, now, limit

    def _at(self, number: int) -> str:
        return f"{self.path}/batch={number}"

    def _ranked(self, rows: DataFrame) -> DataFrame:
        """The scored rows worth keeping, for a place in the ranking or only for holding a maximum."""
        raw = ranking.with_raw(ranking.score(rows, self.query, self.now), self.now)
        firsts = ranking.top(raw, "overall", self.limit).withColumn("kept_for", F.lit("place"))
        holders = [raw.orderBy(F.col(c).desc_nulls_last(), "seq").limit(1).withColumn("kept_for", F.lit("maximum")) for c in ranking.RAW]
        kept = firsts.unionByName(holders[0]).unionByName(holders[1])
        once = kept.groupBy(*self.keys).agg(F.max_by(F.struct(*[c for c in kept.columns if c not in self.keys]), "kept_for").alias("r"))
        return once.select(*self.keys, "r.*")

    def _standing(self, kept: DataFrame) -> tuple:
        """Maxima, number of places, and the last place."""
        placed = F.when(F.col("kept_for") == "place", F.struct(F.col("overall").alias("o"), (-F.col("seq")).alias("s")))
        r = kept.agg(*[F.max(c).alias(c) for c in ranking.RAW], F.count(placed).alias("n"), F.min(placed).alias("last")).first()
        return tuple(r[c] for c in ranking.RAW), r["n"], tuple(r["last"]) if r["last"] else None

    def update(self, spark: SparkSession, table: RunTable, number: int) -> None:
        """Write the snapshot of micro-batch `number`; its column whole tells whether the table was ranked for it."""
        whole = True
        if number:
            before = spark.read.parquet(self._at(number - 1))
            changed = table.changed(spark, number)
            plain = before.select(*[c for c in changed.columns if c in before.columns])
            rows = plain.join(changed.select(*self.keys), self.keys, "left_anti").unionByName(changed.select(*plain.columns))
            self._ranked(rows).withColumn("whole", F.lit(False)).write.mode("overwrite").parquet(self._at(number))
            kept = spark.read.parquet(self._at(number))
            tops, places, last = self._standing(before)
            tops_now, places_now, last_now = self._standing(kept)
            # Fewer places than asked for: the snapshot before held every row there was.
            whole = places >= self.limit and (tops_now != tops or places_now < self.limit or last_now < last)
        if whole:
            self._ranked(table.read(spark)).withColumn("whole", F.lit(True)).write.mode("overwrite").parquet(self._at(number))
        if number >= 3:
            files, at = _folder(spark, self._at(number - 3))
            files.delete(at, True)

    def read(self, spark: SparkSession, number: int) -> DataFrame:
        """Ranked rows after micro-batch `number`, best first."""
        kept = spark.read.parquet(self._at(number)).where(F.col("kept_for") == "place")
        return ranking.top(kept, "overall", self.limit)
