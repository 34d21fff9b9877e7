"""The subpackage's queries and their SQL, as __spark_entry__.py adds them."""

from __future__ import annotations

from . import q_jaccard, q_mixing, q_pipeline, q_quality, q_secrets, q_text, q_vectors

PARTS = (q_jaccard, q_mixing, q_pipeline, q_quality, q_secrets, q_text, q_vectors)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
