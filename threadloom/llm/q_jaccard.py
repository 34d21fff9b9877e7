"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard
from .common import table


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), items AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND b.n * 100 >= 90 * a.n AND a.n * 100 >= 90 * b.n
  GROUP BY a.doc_id, b.doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM shared WHERE 100 * c >= 90 * (na + nb - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.y FROM reach r JOIN (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.x
), smallest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN smallest USING (doc_id)
"""

QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
SQL = {"op2_ngram_jaccard": OP2_SQL}
