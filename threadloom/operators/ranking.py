"""Ranking, slots, packing and vector search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored

#: Queries that go to every task at most, those multiplied at once, and rows of a block where they are more.
BROADCAST_QUERIES, QUERY_BLOCK, POINT_ROWS = 10_000, 64, 16_384


def most_common(df: DataFrame, value: str, n: int | None, seen: str) -> DataFrame:
    """(value, n): the most frequent values, ties to the one seen first; n None for all."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"), F.min(seen).alias("first_seen"))
    ranked = counts.orderBy(F.col("n").desc(), "first_seen", value)
    return ranked if n is None else ranked.limit(n)


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_each(df: DataFrame, keys: Sequence[str], n: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    """The first n rows of each key with their rank; the limit is taken before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def page(df: DataFrame, offset: int, limit: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def random_rows(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows in a seeded order of their keys, the same on every run and partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def _by_range(df: DataFrame, order: Sequence[Column | str], groups: int) -> DataFrame:
    """df, written, with __p: the number of its range in the given order."""
    return stored(df.repartitionByRange(groups, *order).withColumn("__p", F.spark_partition_id()))


def dense_numbers(df: DataFrame, out: str, *order: Column | str, groups: int = 256) -> DataFrame:
    """df with numbers from 1 in the given order, without all rows in one task: ranges are counted, then numbered within."""
    placed = _by_range(df, order, groups)
    path = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = placed.groupBy(F.col("__p").alias("p")).count().withColumn("__s", F.coalesce(F.sum("count").over(path), F.lit(0))).select(F.col("p").alias("__p"), "__s")
    w = Window.partitionBy("__p").orderBy(*order)
    return placed.join(F.broadcast(starts), "__p").withColumn(out, F.row_number().over(w) + F.col("__s")).drop("__p", "__s")


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Callable[[Column], Column]], groups: int = 256) -> DataFrame:
    """(keys, n, picks): of each key the values at places (from 0) that picks give from the number n of its values; null keys are a key, nulls no values.

    Values are counted, ranges of them summed and places found within a range, so no key's values meet in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    placed = _by_range(counts, [*keys, "__v"], groups)
    sums = placed.groupBy(*keys, "__p").agg(F.sum("__c").alias("__c"))
    whole = Window.partitionBy(*keys)
    starts = sums.withColumns({"n": F.sum("__c").over(whole), "__s": F.sum("__c").over(whole.orderBy("__p")) - F.col("__c")})
    starts = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__p").alias("__q"), "n", "__s")
    same = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = placed.join(starts, same)
    upto = F.col("__s") + F.sum("__c").over(Window.partitionBy(*keys, "__p").orderBy("__v"))
    rows = rows.withColumn("__u", upto)
    hit = lambda place: (F.col("__u") > place) & (F.col("__u") - F.col("__c") <= place)
    found = [F.max(F.when(hit(pick(F.col("n"))), F.col("__v"))).alias(name) for name, pick in picks.items()]
    return rows.groupBy(*keys, "n").agg(*found).select(*keys, "n", *picks)


def filters(source: str | None = None, without_low_signal: bool = False, manager: str | None = None, date_from: str | None = None, date_to: str | None = None) -> Column:
    """A point filter of the given conditions, all of which must hold; true without any."""
    out = F.lit(True)
    if source is not None:
        out = out & (F.col("source") == source)
    if without_low_signal:
        out = out & ~F.coalesce(F.col("low_signal"), F.lit(False))
    if manager is not None:
        out = out & F.array_contains("manager_emails", manager)
    if date_from is not None:
        out = out & (F.col("date_start") >= date_from)
    if date_to is not None:
        out = out & (F.col("date_start") <= date_to)
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of unit length; null vectors, those of another length and zero vectors are zero."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
    out = np.zeros((len(lists), dim))
    right = np.flatnonzero(sizes == dim)
    if len(right) and dim:
        flat = lists.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False)
        out[right] = np.asarray(flat, np.float64).reshape(-1, dim)
    norm = np.sqrt((out * out).sum(1))
    return out / np.where(norm > 0, norm, 1.0)[:, None]


def _best(points: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, scores) of each query's k best points, ties to the smaller id. Blocks are multiplied; what may be among the best is scored again, pair by pair."""
    for i in range(0, len(queries), QUERY_BLOCK):
        block = queries[i : i + QUERY_BLOCK]
        scores = points @ block.T
        least = np.partition(scores, len(points) - k, axis=0)[len(points) - k] if len(points) > k else np.full(len(block), -np.inf)
        for j in range(len(block)):
            at = np.flatnonzero(scores[:, j] >= least[j] - 1e-9)
            exact = (points[at] * block[j]).sum(1)
            best = np.lexsort((ids[at], -exact))[:k]
            yield at[best], exact[best]


def search(points: DataFrame, queries: DataFrame, k: int, where: Column | None = None, ident: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, rank, ident, score): exact cosine top k of a stated query set; ties to the smaller id. Null and zero vectors score 0.

    While queries are a checked, small number of rows they go to every task, and points stay in theirs; beyond, blocks of queries
    meet blocks of points. Either way a task multiplies blocks and gives k rows a query."""
    rows = points if where is None else points.where(where)
    asked = queries.select(F.col(query_id).alias("__q"), F.col(query_vector).alias("__v"))
    kinds = rows.select(ident).schema[0].dataType.simpleString(), asked.schema["__q"].dataType.simpleString()
    schema = f"`{query_id}` {kinds[1]}, `{ident}` {kinds[0]}, score double"

    def scored(ids: pa.Array, vectors: pa.Array, named: pa.Array, wanted: np.ndarray) -> pa.RecordBatch:
        matrix = _matrix(vectors, wanted.shape[1])
        ranks = np.argsort(np.argsort(np.asarray(ids.to_pylist(), dtype=object), kind="stable"), kind="stable") if pa.types.is_string(ids.type) else np.asarray(ids)
        found = list(_best(matrix, wanted, ranks, k))
        places = np.concatenate([p for p, _ in found]) if found else np.empty(0, np.int64)
        of = np.repeat(np.arange(len(found)), [len(p) for p, _ in found]) if found else places
        score = np.concatenate([s for _, s in found]) if found else np.empty(0)
        return pa.RecordBatch.from_arrays([named.take(pa.array(of)), ids.take(pa.array(places)), pa.array(score, pa.float64())], names=[query_id, ident, "score"])

    few = asked.limit(BROADCAST_QUERIES + 1).toArrow()
    if few.num_rows <= BROADCAST_QUERIES:
        dim = max([0, *(n for n in pc.list_value_length(few.column("__v")).to_pylist() if n)])
        named, wanted = few.column("__q").combine_chunks(), _matrix(few.column("__v"), dim)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(named):
                    yield scored(batch.column(0), batch.column(1), named, wanted)

        best = rows.select(ident, vector).mapInArrow(run, schema)
    else:
        blocks = max(1, -(-rows.count() // POINT_ROWS)), max(1, -(-asked.count() // POINT_ROWS))
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.select(F.col(ident).alias("__i"), F.col(vector).alias("__x"), block(ident, blocks[0]).alias("__a")).withColumn("__b", every(blocks[1]))
        right = asked.withColumn("__b", block("__q", blocks[1])).withColumn("__a", every(blocks[0]))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            dim = max([0, *(n for n in pc.list_value_length(b.column("__v")).to_pylist() if n)])
            a, b = a.combine_chunks(), b.combine_chunks()
            return pa.Table.from_batches([scored(a.column("__i").combine_chunks(), a.column("__x").combine_chunks(), b.column("__q").combine_chunks(), _matrix(b.column("__v"), dim))])

        best = left.groupBy("__a", "__b").cogroup(right.groupBy("__a", "__b")).applyInArrow(meet, schema)
    return top_each(best, [query_id], k, F.col("score").desc(), ident).select(query_id, "rank", ident, "score")


def merged_queries(results: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """(rank, key, score) over all queries' results: each document once with its best score, ties to the smaller key."""
    best = results.groupBy(key).agg(F.max(score).alias(score))
    ranked = best.orderBy(F.col(score).desc(), key).limit(k)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), key)))


def reserved_slots(results: DataFrame, by: Sequence[str], official: Column, key: str, k: int, slots: int, least: float, score: str = "score") -> DataFrame:
    """results with rank: up to so many official rows of at least the least score first, then all by score, up to k.

    The official rows are cut to the slots before their score is looked at, and those kept are never cut by k."""
    best = top_each(results, [*by, key], 1, F.col(score).desc(), rank="__d").drop("__d")
    order = (F.col(score).desc(), F.col(key))
    ranked = best.withColumn("__o", official).withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__o").orderBy(*order)))
    ranked = ranked.withColumn("reserved", F.col("__o") & (F.col("__n") <= slots) & (F.col(score) >= least))
    w = Window.partitionBy(*by).orderBy(F.col("reserved").desc(), *order)
    held = F.sum(F.col("reserved").cast("int")).over(Window.partitionBy(*by))
    return ranked.withColumns({"rank": F.row_number().over(w), "__h": held}).where(F.col("rank") <= F.greatest(F.lit(k), "__h")).drop("__o", "__n", "__h")


def greedy_packs(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """(group, order, pack): rows in order fill a pack until the next would pass the budget; a pack has a row at least.

    A group's sizes, not its texts, meet in one task."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        number, used, out = 1, 0, []
        for s in pdf[size]:
            if used and used + s > budget:
                number, used = number + 1, 0
            used += s
            out.append(number)
        return pd.DataFrame({group: pdf[group], order: pdf[order], "pack": out})

    slim = df.select(group, F.col(order).cast("long").alias(order), F.col(size).cast("long").alias(size))
    kind = df.select(group).schema[0].dataType.simpleString()
    return slim.groupBy(group).applyInPandas(pack, f"{group} {kind}, {order} long, pack long")


def ratios(df: DataFrame, left: str, right: str, out: str = "ratio") -> DataFrame:
    """df with the matching-blocks similarity of two texts, 1.0 for two empty ones; a pair's work is the product of their lengths at worst."""
    import difflib

    @F.pandas_udf("double")
    def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([1.0 if not x and not y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    return df.withColumn(out, ratio(F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))))
