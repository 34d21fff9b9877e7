"""Approximate nearest neighbours by collision counting.

Vectors are dealt to blocks by a hash of their id. A block projects its vectors on random directions and keeps each
projection as a sorted array. A query opens a window around its own projection in each array; windows widen together,
as if rehashed at a larger radius, and only what newly enters is counted. A vector that lies in enough windows is
verified by its exact distance; that is a few percent of a block's vectors. A query stops in a block when its k-th verified distance is within the radius that the
windows stand for, or when the windows hold the whole block. Candidates are never capped, so the only misses
are near vectors that fall outside too many windows; each block's best k meet in one ranking a query.

Every block of queries meets every block of vectors, as a stated query set against all rows: the work is their product,
and each task holds one block of either.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor rows without an id; rows that
repeat id and vector count once; vectors of other dimensions are not compared; ties go to the smaller id; equal
vectors are at distance 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROJECTIONS, WIDTH, THRESHOLD, GROWTH, SEED = 256, 2.0, 0.645, 1.04, 20_240
#: Rows of a block of vectors, and of a block of queries.
BLOCK_ROWS, QUERY_ROWS = 16_384, 8192


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Index:
    """Sorted projections of one block of vectors; verified counts the vectors that its searches compared exactly."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.ids, self.vectors = ids, vectors
        self.directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], projections))
        projected = vectors @ self.directions
        order = np.argsort(projected, axis=0, kind="stable")
        by_rank = np.take_along_axis(projected, order, 0).T
        # the arrays stand one behind another, each lifted over the one before, so that one search places all windows
        self.low, self.high = by_rank[:, 0].copy(), by_rank[:, -1].copy()
        span = float((self.high - self.low).max()) + 1.0
        self.lift = np.arange(projections) * 2 * span - self.low
        self.sorted = (by_rank + self.lift[:, None]).ravel()
        self.order = np.ascontiguousarray(order.T).ravel()
        self.begins = np.arange(projections) * len(ids)
        self.floor = max(float(np.median(projected.std(0))) / 16, 1e-12)
        self.least = self.floor
        self.verified = 0

    def _places(self, values: np.ndarray, side: str) -> np.ndarray:
        """The place of values[j] in array j."""
        return np.searchsorted(self.sorted, np.clip(values, self.low - 0.25, self.high + 0.25) + self.lift, side)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest found, own id left out, nearest first."""
        n, m = len(self.ids), len(self.begins)
        at = query @ self.directions
        need = math.ceil(THRESHOLD * m)
        counts = np.zeros(n, np.intp)
        low = high = self._places(at, "left")
        distance = np.full(n, np.inf)
        seen = self.ids == own
        self.verified -= int(seen.sum())
        radius, last = self.least, 0.0
        while True:
            half = WIDTH * radius / 2
            a, b = np.minimum(self._places(at - half, "left"), low), np.maximum(self._places(at + half, "right"), high)
            entered = [self.order[i:j] for i, j in zip(np.concatenate((a, high)).tolist(), np.concatenate((low, b)).tolist(), strict=True) if i < j]
            if entered:
                counts += np.bincount(np.concatenate(entered), minlength=n)
            low, high = a, b
            fresh = np.flatnonzero((counts >= need) & ~seen)
            if len(fresh):
                seen[fresh] = True
                gap = self.vectors[fresh] - query
                distance[fresh] = np.sqrt((gap * gap).sum(1))
            if np.count_nonzero(distance <= radius) >= k or int((b - a).min()) == n:
                break
            last, radius = radius, radius * GROWTH
        self.verified += int(seen.sum())
        self.least = max(self.floor, 0.8 * (last or radius / GROWTH))  # where the next query begins
        found = np.flatnonzero(np.isfinite(distance))
        if len(found) > k:
            edge = np.partition(distance[found], k - 1)[k - 1]
            found = found[distance[found] <= edge]
        found = found[np.lexsort((self.ids[found], distance[found]))][:k]
        return distance[found], self.ids[found]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of queries its k nearest rows of vectors; both have vec_id, embedding."""

    def clean(df: DataFrame) -> DataFrame:
        kept = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        return kept.withColumn("dim", F.size("embedding")).dropDuplicates(["vec_id", "embedding"])

    rows, asked = clean(vectors), clean(queries)
    blocks = max(1, math.ceil(rows.count() / block_rows))
    query_blocks = max(1, math.ceil(asked.count() / query_rows))

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    left = rows.withColumn("block", dealt(blocks)).withColumn("query_block", all_of(query_blocks))
    right = asked.withColumn("query_block", dealt(query_blocks)).withColumn("block", all_of(blocks))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(data: pa.Table, asking: pa.Table) -> pa.Table:
        if not data.num_rows or not asking.num_rows:
            return schema.empty_table()
        data, asking = data.sort_by("vec_id"), asking.sort_by("vec_id")
        index = Index(data.column("vec_id").to_numpy(), _matrix(data.column("embedding")))
        out = []
        for own, query in zip(asking.column("vec_id").to_numpy(), _matrix(asking.column("embedding")), strict=True):
            score, ids = index.search(int(own), query, k)
            out.append((np.full(len(ids), own), ids, score))
        q, i, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], schema=schema)

    keys = ["dim", "block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
