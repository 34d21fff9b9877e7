"""Query of mixing to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .common import table

#: Curated sources weigh three times the general ones; English as much as the other languages together.
PLAN = mixing.Plan(
    domains={f"src{i}": "curated" for i in range(5, 12)},
    domain={"curated": 3, "general": 1},
    lang={"en": 6, "fr": 2, "de": 2, "es": 2},
    num=3,
    den=5,
    epochs=2,
)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), PLAN).where("__copies > 0")
    return rows.select("doc_id", "__leaf.domain", F.col("__leaf.lang").alias("lang"), F.col("__leaf.source").alias("source"), "__leaf.tokens", F.col("__leaf.budget").alias("leaf_budget"), F.col("__copies").alias("copies"))


def _levels() -> str:
    """Budgets down the tree without an order of children: a child takes its capacity where, filled to its share of weight, all children fit the budget."""
    out, given = [], f"root AS (SELECT CAST((sum(tokens) * {PLAN.num}) // {PLAN.den} AS HUGEINT) AS budget FROM leaves)"
    out.append(given)
    parent = "root"
    for depth, name in enumerate(mixing.LEAF):
        keys, up = ", ".join(mixing.LEAF[: depth + 1]), ", ".join(mixing.LEAF[:depth])
        weight = mixing.case_sql(name, getattr(PLAN, name), PLAN.weight)
        same = " AND ".join(f"a.{c} = j.{c}" for c in mixing.LEAF[:depth]) or "true"
        out.append(f"""kid{depth} AS (SELECT {keys}, CAST(sum(tokens) * {PLAN.epochs} AS HUGEINT) AS cap, CAST({weight} AS HUGEINT) AS w, any_value(budget) AS b FROM leaves {f'JOIN {parent} USING ({up})' if depth else f', {parent}'} GROUP BY {keys}),
filled{depth} AS (SELECT {', '.join(f'a.{c}' for c in mixing.LEAF[: depth + 1])}, a.cap, a.w, a.b, sum(least(j.cap * a.w, j.w * a.cap)) AS filled FROM kid{depth} a JOIN kid{depth} j ON {same} GROUP BY ALL),
fits{depth} AS (SELECT *, filled <= b * w AS takes_all FROM filled{depth}),
open{depth} AS (SELECT {up + ', ' if depth else ''}coalesce(sum(cap) FILTER (WHERE takes_all), 0) AS spent, sum(w) FILTER (WHERE NOT takes_all) AS weights FROM fits{depth}{f' GROUP BY {up}' if depth else ''}),
level{depth} AS (SELECT {keys}, CAST(CASE WHEN takes_all THEN cap ELSE w * (b - CAST(spent AS HUGEINT)) // CAST(weights AS HUGEINT) END AS HUGEINT) AS budget FROM fits{depth} {f'JOIN open{depth} USING ({up})' if depth else f', open{depth}'})""")
        parent = f"level{depth}"
    return ",\n".join(out) + f",\nbudgets AS (SELECT {', '.join(mixing.LEAF)}, tokens, budget FROM leaves JOIN {parent} USING ({', '.join(mixing.LEAF)}))"


def _oracle() -> str:
    domain = mixing.case_sql("coalesce(source, '')", PLAN.domains, PLAN.other_domain)
    leaf = ", ".join(mixing.LEAF)
    return f"""
WITH slim AS (
  SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST((strlen(coalesce(text, '')) + 3) // 4 AS BIGINT) AS t FROM documents
), leaves AS (SELECT {leaf}, sum(t) AS tokens FROM slim GROUP BY {leaf}),
{_levels()},
ordered AS (
  SELECT slim.*, budget, CASE WHEN tokens > 0 THEN CAST(budget // tokens AS BIGINT) ELSE 0 END AS whole,
    CAST(budget - CASE WHEN tokens > 0 THEN (budget // tokens) * tokens ELSE 0 END AS BIGINT) AS remaining,
    md5('{PLAN.seed}:' || CASE WHEN tokens > 0 THEN CAST(budget // tokens AS BIGINT) ELSE 0 END || ':' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM slim JOIN budgets USING ({leaf})
), ran AS (
  SELECT *, sum(t) OVER (PARTITION BY {leaf} ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM ordered
)
SELECT doc_id, domain, lang, source, t AS tokens, CAST(budget AS BIGINT) AS leaf_budget, CAST(whole + (remaining > 0 AND upto <= remaining)::INT AS BIGINT) AS copies
FROM ran WHERE budget > 0 AND whole + (remaining > 0 AND upto <= remaining)::INT > 0
"""


QUERIES = {"op5_source_mixing": op5_source_mixing}
SQL = {"op5_source_mixing": _oracle()}
