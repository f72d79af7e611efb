"""Approximate nearest neighbours by an inverted multi-index.

Vectors, scaled to length one, are cut into two halves, each quantised by centroids of its own; an index cell is a pair
of centroids. A query goes through the cells by the sum of the distances of its halves to the centroids, nearest first,
with a heap over the sorted lists of the two halves, until the cells taken hold the wanted number of entries; the last
sum is its radius. The entries of all cells within the radius are ranked anew by their exact cosine.

Centroids, about 0.75 sqrt(n) for each half, are fitted on a bounded sample (``SAMPLE_ROWS``, or ``ROWS_PER_CENTROID``
for each); every vector is indexed. The wanted number is ``BUDGET * n ** POWER``, so its share of all falls as the table
grows (0.71 of 500 vectors, 0.58 of 2 000, 0.35 of 51 000, 0.08 of 10 ** 9). Recall is tested against brute force.

Scale: first-half centroids, in the order of their main direction, are put on shelves of about ``SHELF_VECTORS`` entries;
a larger one is dealt into shards by a hash, so a centroid with a third of all vectors makes more tasks, not larger
ones. An entry is sent to its shelf (once for each ``BLOCK_QUERIES`` queries of the table), a query to the shelves that
its radius reaches. There entries come first and are held, queries are streamed past them and leave their best few. On
the driver are centroids, cell counts (at most ``MAX_CENTROIDS`` squared) and the sample.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperweave.llm.common import hash_share, materialise, shuffle_partitions, table, trimmed

SAMPLE_ROWS, ROWS_PER_CENTROID, ITERATIONS, MAX_CENTROIDS = 4_096, 32, 12, 1_024
BUDGET, POWER = 1.8, 0.85
SHELF_VECTORS, BLOCK_QUERIES = 16_384, 262_144


def _floats(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    x = x[np.random.default_rng(seed).permutation(len(x))]
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(seed + 1).permutation(len(c))[:k]].copy()
    for _ in range(ITERATIONS):
        near = nearest_centroid(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> float:
    """The sum of distances up to which cells, taken by it, hold ``wanted`` entries (or all).

    The heap has the next cell of each row that has begun; a row begins after the row before it."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    one, two, held = first[a].tolist(), second[b].tolist(), counts[a][:, b].tolist()
    heap, got, at = [(one[0] + two[0], 0, 0)], 0, 0.0
    while heap and got < wanted:
        at, i, j = heap[0]
        got += held[i][j]
        if j + 1 < len(two):
            heapq.heapreplace(heap, (one[i] + two[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < len(one):
            heapq.heappush(heap, (one[i + 1] + two[0], i + 1, 0))
    return at


def shelves(sizes: np.ndarray, order: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(shelf of each centroid, shards of each shelf): centroids in order, as many together as ``limit`` entries."""
    shelf, at, held = np.zeros(len(sizes), np.int64), 0, 0
    for c in order:
        if held and held + sizes[c] > limit:
            at, held = at + 1, 0
        shelf[c] = at
        held += int(sizes[c])
    total = np.bincount(shelf, sizes, at + 1)
    return shelf, np.maximum(1, -(-total // limit)).astype(np.int64)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", budget: float = BUDGET, shelf_vectors: int = SHELF_VECTORS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, by cosine in double precision.

    ``is_query``: condition on the column ``vec_id``. Candidates are all vectors but the query's own; with fewer than k,
    all come. Ties go to the smaller id; repeated rows of an id are one vector (the smallest of them), before anything
    is indexed or counted. Vectors that are null, empty, zero, hold null or non-finite components, have a null id or
    another length than the most common one take no part. Other columns are not read. No usable rows: an empty result.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        return spark.createDataFrame([], schema)
    width = common[0]
    half = (width + 1) // 2
    sides = (slice(0, half), slice(half, None))
    one = materialise(rows.where(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    total = one.count()
    size = int(min(MAX_CENTROIDS, max(2, 0.75 * total**0.5)))
    sampled = max(SAMPLE_ROWS, ROWS_PER_CENTROID * size)
    sample = one.where(hash_share(F.xxhash64("vec_id"), total, 1.25 * sampled)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sampled).toPandas()
    x = unit(np.array(sample.v.tolist()))
    halves = (kmeans(x[:, sides[0]], size), kmeans(x[:, sides[1]], size) if width > 1 else np.zeros((1, 0)))
    del x, sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = unit(_floats(batch.column(1), width))
                ij = [nearest_centroid(u[:, s], c).astype(np.int32) for s, c in zip(sides, halves)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, ij)], names=["vec_id", "v", "i", "j"])

    placed = materialise(one.mapInArrow(trimmed(place), "vec_id long, v array<double>, i int, j int"), "multi-index")
    counts = np.zeros((len(halves[0]), len(halves[1])), np.int64)
    for i, j, n in placed.groupBy("i", "j").count().collect():  # at most one row for each cell
        counts[i, j] = n
    wanted = max(k + 1, int(budget * total**POWER))
    queries = placed.where(is_query)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    main = halves[0] @ np.linalg.svd(halves[0] - halves[0].mean(0), full_matrices=False)[2][0]
    shelf_of, shards = shelves(counts.sum(1), np.argsort(main, kind="stable"), shelf_vectors)
    below = [np.flatnonzero(shelf_of == s) for s in range(len(shards))]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shelf with cells within the query's radius."""
        for batch in batches:
            if not batch.num_rows:
                continue
            u = unit(_floats(batch.column(1), width))
            d = [distances(u[:, s], c) for s, c in zip(sides, halves)]
            at, there, radii = [], [], []
            for r in range(len(u)):
                radius = traverse(d[0][r], d[1][r], counts, wanted) + 1e-9
                least = d[1][r].min()
                for s in np.flatnonzero([len(b) and d[0][r][b].min() + least <= radius for b in below]).tolist():
                    at.append(r)
                    there.append(s)
                    radii.append(radius)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())), pa.array(there, pa.int32()), pa.array(radii, pa.float64())], names=["id", "v", "shelf", "radius"])

    def listed(values: np.ndarray) -> Column:
        return F.array(*[F.lit(int(v)) for v in values])

    n_shards = F.element_at(listed(shards), F.col("shelf") + 1)
    routed = queries.select("vec_id", "v").mapInArrow(trimmed(route), "id long, v array<double>, shelf int, radius double")
    routed = routed.select("id", "v", F.lit(0).alias("i"), F.lit(0).alias("j"), "radius", "shelf", F.explode(F.sequence(F.lit(0), n_shards - 1)).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    entries = placed.withColumn("shelf", F.element_at(listed(shelf_of), F.col("i") + 1))
    entries = entries.select(F.col("vec_id").alias("id"), "v", "i", "j", F.lit(None).cast("double").alias("radius"), "shelf", F.pmod(F.xxhash64("vec_id"), n_shards).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of a shelf's shard come before its queries."""
        place, held, ready = None, [], None
        for batch in batches:
            where = np.column_stack([batch.column(c).to_numpy() for c in (5, 6, 7)])
            asks = np.asarray(batch.column(4).is_valid())
            ids, ij = batch.column(0).to_numpy(), [batch.column(c).to_numpy() for c in (2, 3)]
            u = unit(_floats(batch.column(1), width))
            cuts = np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(1) | (asks[1:] != asks[:-1])))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)]):
                if place != tuple(where[lo]):
                    place, held, ready = tuple(where[lo]), [], None
                if not asks[lo]:
                    held.append((ids[lo:hi], u[lo:hi], ij[0][lo:hi], ij[1][lo:hi]))
                elif held:
                    ready = ready or tuple(np.concatenate(c) for c in zip(*held))
                    yield best(ids[lo:hi], u[lo:hi], batch.column(4).slice(lo, hi - lo).to_numpy(), *ready)

    def best(queries: np.ndarray, qs: np.ndarray, radii: np.ndarray, ids: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        """Twice the k best of each query here, so that what is left to rounding is decided by the exact measure later."""
        d, out = [distances(qs[:, s], c) for s, c in zip(sides, halves)], []
        for r, query in enumerate(queries.tolist()):
            pick = np.flatnonzero((d[0][r][i] + d[1][r][j] <= radii[r]) & (ids != query))
            s = np.round(x[pick] @ qs[r], 13)
            if len(s) > 4 * k:
                near = s >= np.partition(s, -2 * k)[-2 * k]
                pick, s = pick[near], s[near]
            top = np.lexsort((ids[pick], -s))[: 2 * k]
            out.append((np.full(len(top), query), ids[pick[top]], s[top]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "s"])

    together = entries.unionByName(routed).repartition(max(shuffle_partitions(spark), min(int(shards.sum()) * blocks, 4 * shuffle_partitions(spark))), "shelf", "shard", "block")
    near = together.sortWithinPartitions("shelf", "shard", "block", F.col("radius").isNotNull()).mapInArrow(trimmed(rank), "query_id long, vec_id long, s double")
    few = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    near = near.withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= 2 * k).select("query_id", "vec_id")
    near = near.join(one, "vec_id").join(one.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.select("query_id", "vec_id", _cosine(F.col("q"), F.col("v")).alias("score")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _cosine(a: Column, b: Column) -> Column:
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = lambda x, y: add(F.zip_with(x, y, lambda p, q: p * q))
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the five nearest of every vector whose id is divisible by 50, among all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
