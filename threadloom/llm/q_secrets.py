"""Query of secret scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets
from .common import table


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every document, with its verdict; values are given by digest only."""
    import public_tokenizers

    words = secrets.dictionary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), words=words)
    rows = found.select("doc_id", F.posexplode("__findings").alias("n", "x"))
    return rows.select("doc_id", "n", F.col("x.at").alias("word"), F.col("x.kind").alias("kind"), F.length("x.value").cast("long").alias("n_chars"), F.sha2(F.col("x.value").cast("binary"), 256).alias("value_sha256"), F.col("x.score").alias("score"), F.col("x.is_secret").alias("is_secret"))


QUERIES = {"op7_secret_scan": op7_secret_scan}
SQL: dict[str, str] = {}
