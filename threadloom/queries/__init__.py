"""Registered queries of the library and their SQL."""

from __future__ import annotations

from . import analytics, cleaning, corpus, faq, files, relational, retrieval, temporal  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries() -> dict:
    """Name to callable (spark, sf_dir) -> DataFrame."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return dict(SQL)
