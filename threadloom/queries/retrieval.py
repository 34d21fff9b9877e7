"""Vector search with filters, slots and several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, tokens
from ..operators import ranking
from .registry import Tables, query

_SCORES = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, label, list_cosine_similarity(embedding::DOUBLE[], qv) AS score FROM embeddings, q)"""


def queries(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"WITH {_SCORES} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 6")
def cosine_topk(t: Tables) -> DataFrame:
    """Exact cosine top 6 of each query (rows O1, V4, V7, J11)."""
    return ranking.search(t.embeddings, queries(t), 6).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORES} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, round(score, 6) AS score FROM s WHERE label IN (1, 3) QUALIFY rank <= 6")
def filtered_topk(t: Tables) -> DataFrame:
    """The same under a filter that reaches the scan (rows V5, P1)."""
    return ranking.search(t.embeddings, queries(t), 6, where=F.col("label").isin(1, 3)).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


_SLOTS = f"""{_SCORES}, g AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 6),
o AS (SELECT * FROM s WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 2),
u AS (SELECT query_id, vec_id, score, 1 AS reserved FROM o WHERE score >= 0.3 UNION ALL SELECT query_id, vec_id, score, 0 FROM g WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.query_id = g.query_id AND o.vec_id = g.vec_id AND o.score >= 0.3))"""


@query(f"""WITH {_SLOTS} SELECT query_id, vec_id, reserved = 1 AS reserved, row_number() OVER (PARTITION BY query_id ORDER BY reserved DESC, score DESC, vec_id) AS rank, round(score, 6) AS score FROM u
QUALIFY rank <= greatest(6, sum(reserved) OVER (PARTITION BY query_id))""")
def reserved_slot_merge(t: Tables) -> DataFrame:
    """Official results first in their slots, then all others (rows V6, W15, O3)."""
    both = ranking.search(t.embeddings, queries(t), 6).unionByName(ranking.search(t.embeddings, queries(t), 2, where=F.col("label") == 0))
    named = both.join(t.embeddings.select("vec_id", "label"), "vec_id")
    merged = ranking.reserved_slots(named, ["query_id"], F.col("label") == 0, "vec_id", 6, 2, 0.3)
    return merged.select("query_id", "vec_id", "reserved", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_SCORES}, r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 6), m AS (SELECT vec_id, max(round(score, 6)) AS score FROM r GROUP BY 1)
SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM m QUALIFY rank <= 12""")
def multi_query_merge(t: Tables) -> DataFrame:
    """Several queries' results, each document once with its best score (rows O2, V9, V10)."""
    found = ranking.search(t.embeddings, queries(t), 6).withColumn("score", F.round("score", 6))
    return ranking.merged_queries(found, "vec_id", 12).select("vec_id", "score", "rank")


@query(f"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z'']{{3,}}')) AS x FROM benchmark), c AS (SELECT item_id, ('0x' || right(md5(x), 2))::INT AS place, count(*) AS n FROM w GROUP BY ALL)
SELECT item_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS value FROM c""")
def feature_hash_embed(t: Tables) -> DataFrame:
    """Words hashed into a unit vector of 256 places (rows V3, V1)."""
    v = t.benchmark.select("item_id", F.posexplode(numbers.hashed_vector(tokens.words_of(F.col("text")), 256)).alias("place", "value"))
    return v.where("value > 0").select("item_id", "place", F.round("value", 6).alias("value"))


@query(f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s QUALIFY k <= 3)
SELECT query_id, string_agg('[' || k || '] ' || CASE WHEN label = 0 THEN 'official' ELSE 'thread' END || ' ' || vec_id, chr(10) || '---' || chr(10) ORDER BY k) AS context FROM r GROUP BY 1""")
def context_assembly(t: Tables) -> DataFrame:
    """Numbered context of the found documents (rows V11, V12, V13, V14)."""
    r = ranking.search(t.embeddings, queries(t), 3).join(t.embeddings.select("vec_id", "label"), "vec_id")
    line = F.format_string("[%d] %s %d", "rank", F.when(F.col("label") == 0, "official").otherwise("thread"), "vec_id")
    return r.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("x")))), lambda s: s["x"]), "\n---\n").alias("context"))
