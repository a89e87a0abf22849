"""Nearest neighbours by largest inner product: multiprobe p-stable hashing with exact reranking.

Vectors get one more component that makes all of them equally long, so the largest inner product is the smallest
distance. Each table hashes a vector to the cell of its K rounded Gaussian projections. A query visits the cells around
its own in the order of the chance that a neighbour at the expected distance lies there, until these chances add up
to the wanted success; several tables are merged, and what they found is ranked by the exact product.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmetrics.session import written

ROUNDING = 1e-11  # of the largest product a query can have: by this much a block product may miss the exact one


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Tables:
    """Projections of all tables for vectors of one number of components; the same on every machine."""

    def __init__(self, dim: int, tables: int, functions: int, cell: float, seed: int = 11) -> None:
        rng = np.random.default_rng([seed, dim])
        self.slopes = rng.standard_normal((tables, dim + 1, functions))
        self.shifts = rng.uniform(0, 1, (tables, 1, functions))
        self.codes = rng.integers(0, 1 << 63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.cell = cell

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """(table, vector, function): the projections in units of a cell."""
        return np.einsum("vd,tdf->tvf", vectors, self.slopes) / self.cell + self.shifts

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        """One number for each row of cells."""
        return (cells.astype(np.int64).view(np.uint64) * self.codes).sum(axis=-1, dtype=np.uint64).view(np.int64)

    def probes(self, place: np.ndarray, spread: float, success: float, most: int = 1 << 16) -> np.ndarray:
        """Buckets in the order of the chance that a neighbour is there, up to the wanted success."""
        chance, cells = np.ones(1), np.zeros((1, 0), dtype=np.int64)
        for at in place:
            low = np.arange(np.floor(at - 3.5 * spread), np.floor(at + 3.5 * spread) + 1)
            edges = np.array([0.5 + 0.5 * erf((x - at) / spread / 2**0.5) for x in [*low, low[-1] + 1]])
            chance = np.outer(chance, np.diff(edges)).ravel()
            cells = np.concatenate([np.repeat(cells, len(low), 0), np.tile(low.astype(np.int64), len(cells))[:, None]], axis=1)
            order = np.argsort(-chance, kind="stable")[:most]
            chance, cells = chance[order], cells[order]
        return self.bucket(cells[:int(np.searchsorted(np.cumsum(chance), success)) + 1])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and matrix of the rows of a batch, for each number of components."""
    ids, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield ids[at], np.array([vectors[i] for i in at], dtype=np.float64)


def _lengthened(vectors: np.ndarray, longest: float, query: bool) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1)
    if query:
        return np.concatenate([vectors * (longest / norms)[:, None], np.zeros((len(vectors), 1))], axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(longest**2 - norms**2, 0))[:, None]], axis=1)


def neighbour_distance(classes: DataFrame, queries: DataFrame, longest: float, total: int, k: int, sample: int) -> float:
    """A distance that covers the k-th neighbour of most queries, from no more than `sample` vectors of each table."""
    def take(df: DataFrame, n: int) -> list:
        return [r.vector for r in df.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(n).collect()]

    rows, asked = take(classes, sample), take(queries, sample // 8)
    found = []
    for size in {len(v) for v in asked}:
        q, x = (np.array([v for v in vs if len(v) == size], dtype=np.float64) for vs in (asked, rows))
        if len(x) > 1:
            d = np.sqrt(np.maximum(2 * longest**2 - 2 * _lengthened(q, longest, True) @ _lengthened(x, longest, False).T, 0))
            rank = min(max(round(k * len(x) / total), 1), d.shape[1] - 1)
            found += np.sort(d, axis=1)[:, rank].tolist()
    return float(np.quantile(found, 0.8)) if found else longest


def _shard_search(k: int):
    """Best products of the queries of a shard with the members of the buckets they visit."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            bucket = left["bucket"].to_numpy()
            order = np.argsort(bucket, kind="stable")
            bucket, ids, base = bucket[order], left["id"].to_numpy()[order], _matrix(left["vector"].combine_chunks())[order]
            longest = np.linalg.norm(base, axis=1).max()
            names, begins = np.unique(bucket, return_index=True)
            ends = np.append(begins[1:], len(bucket))
            for at in range(0, len(right), 128):
                part = right.slice(at, 128)
                q, asked = _matrix(part["vector"].combine_chunks()), part["id"].to_numpy()
                visits = [np.searchsorted(names, v)[np.isin(v, names)] if v is not None else np.arange(len(names)) for v in (
                    None if v is None else np.array(v, dtype=np.int64) for v in part["buckets"].to_pylist())]
                query, visited = np.repeat(np.arange(len(part)), [len(v) for v in visits]), np.concatenate(visits).astype(np.int64)
                by = np.argsort(visited, kind="stable")
                query, visited = query[by], visited[by]
                scores = np.full((len(part), len(base)), -np.inf)
                cuts = np.flatnonzero(np.diff(visited, prepend=-1))
                for low, high in zip(cuts, np.append(cuts[1:], len(visited))):
                    members = slice(begins[visited[low]], ends[visited[low]])
                    scores[query[low:high], members] = q[query[low:high]] @ base[members].T
                # All at the border value stay until exact products and ids decide between them.
                most = min(k, len(base))
                border = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
                slack = ROUNDING * longest * np.linalg.norm(q, axis=1)
                for row in range(len(part)):
                    near = np.flatnonzero((scores[row] >= border[row] - slack[row]) & (scores[row] > -np.inf))
                    exact = np.einsum("ij,j->i", base[near], q[row])
                    chosen = np.lexsort((ids[near], -exact))[:k]
                    out.append((np.full(len(chosen), asked[row]), ids[near[chosen]], exact[chosen]))
        columns = [np.concatenate(c) if out else np.zeros(0) for c in (zip(*out) if out else [[]] * 3)]
        kinds = [np.int64, np.int64, np.float64]
        return pa.table({n: c.astype(t) for n, c, t in zip(("query", "id", "score"), columns, kinds)})

    return run


def nearest(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, tables: int = 2,
    functions: int = 6, success: float = 0.85, shard: int = 8192, sample: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for every row that is_query holds for.

    Scores are products in double precision, ties go to the smaller id, a query is no candidate for itself. Equal
    vectors are searched once and share their result, so a vector that very many rows hold costs what one costs; of
    each only the k + 1 smallest ids can be among any query's k nearest. A bucket of more than `shard` vectors is dealt
    to several shards. A query that finds fewer than k goes on to all buckets. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without id, take no part; vectors of different sizes never meet; rows
    that repeat an id count each as a candidate; a table without usable vectors gives no rows; other columns are ignored.
    """
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    firsts = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = written(
        firsts.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("id"), "ids", "vector"), "vector-classes")
    asked = written(rows.where("asks").groupBy("vector").agg(F.min("id").alias("id")), "vector-queries")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    total, members, longest = classes.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.max(norm)).first()
    longest = float(longest or 1.0)
    distance = max(neighbour_distance(classes, asked, longest, max(total, 1), k, sample), 1e-3 * longest)
    shards = max(-(-total // shard), 1)

    def tables_for(dim: int) -> Tables:
        return Tables(dim, tables, functions, 2 * distance)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors in _by_size(batch):
                own = tables_for(vectors.shape[1])
                buckets = own.bucket(np.floor(own.places(_lengthened(vectors, longest, False))))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(ids), vectors.shape[1] * tables + t), pa.int64()), pa.array(buckets[t]), pa.array(ids),
                        pa.array(list(vectors), pa.list_(pa.float64()))], names=["table", "bucket", "id", "vector"])

    base = written(classes.select("id", "vector").mapInArrow(hashed, "table long, bucket long, id long, vector array<double>"), "vector-buckets")
    large = base.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard)
    pieces = {(r.table, r.bucket): -(-r.n // shard) for r in large.collect()}  # tables * vectors / shard rows at most

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ids, vectors in _by_size(batch):
                own = tables_for(vectors.shape[1])
                places = own.places(_lengthened(vectors, longest, True))
                for t in range(tables):
                    table = vectors.shape[1] * tables + t
                    for i, id_ in enumerate(ids.tolist()):
                        buckets = own.probes(places[t, i], 0.5, success)
                        home = buckets.view(np.uint64) % np.uint64(shards)
                        more = [(b, (int(b) + p) % shards) for b in buckets.tolist() if (table, b) in pieces for p in range(1, pieces[table, b])]
                        home = np.append(home.astype(np.int64), np.array([h for _, h in more], np.int64))
                        buckets = np.append(buckets, np.array([b for b, _ in more], np.int64))
                        for s in np.unique(home).tolist():
                            out.append((table, s, id_, vectors[i], buckets[home == s]))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["table", "shard", "id", "vector", "buckets"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, bucket, ids = (batch.column(i).to_numpy() for i in range(3))
            home = (bucket.view(np.uint64) % np.uint64(shards)).astype(np.int64)
            for i in np.flatnonzero([(t, b) in pieces for t, b in zip(table.tolist(), bucket.tolist())]) if pieces else []:
                home[i] = (int(bucket[i]) + int(ids[i]) % pieces[int(table[i]), int(bucket[i])]) % shards
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], names=["table", "bucket", "id", "vector", "shard"])

    placed = base.mapInArrow(dealt, "table long, bucket long, id long, vector array<double>, shard long")
    search = _shard_search(k + 1)

    def found(route: DataFrame, of: DataFrame) -> DataFrame:
        return of.groupBy("table", "shard").cogroup(route.groupBy("table", "shard")).applyInArrow(search, "query long, id long, score double")

    asking = asked.select("id", "vector").repartition(max(-(-asked.count() // 256), 1), "id")
    route = asking.mapInArrow(routed, "table long, shard long, id long, vector array<double>, buckets array<long>")
    def best(pairs: DataFrame, name: str) -> DataFrame:
        """The k + 1 best classes of each query: no id outside them can be among its k + 1 nearest."""
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        pairs = pairs.groupBy("query", "id").agg(F.max("score").alias("score"))
        return written(pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"), name)

    top = best(found(route, placed), "vector-best")
    enough = top.join(classes.select("id", F.size("ids").alias("n")), "id").groupBy("query").agg(F.sum("n").alias("n"))
    short = asked.join(enough, asked["id"] == enough["query"], "left").where(F.coalesce("n", F.lit(0)) < min(k + 1, members))
    short = written(short.select("id", "vector"), "vector-short")
    if not short.isEmpty():
        everywhere = short.select(
            (F.size("vector") * tables).cast("long").alias("table"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).cast("long").alias("shard"),
            "id", "vector", F.lit(None).cast("array<long>").alias("buckets"))
        top = best(top.unionByName(found(everywhere, placed.where(F.col("table") % tables == 0))), "vector-best-all")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        top.join(classes.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    )
    queries = rows.where("asks").select(F.col("id").alias("query_id"), "vector").join(asked.withColumnRenamed("id", "query"), "vector").select("query_id", "query")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.join(lists, "query").where("query_id <> vec_id").withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
