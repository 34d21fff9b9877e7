"""Queries of media columns and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, media
from .common import table


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_media(media.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


QUERIES = {"op9_media_columns": op9_media_columns, "op10_nearest_neighbours": op10_nearest_neighbours}
SQL: dict[str, str] = {}
