"""Registration of queries: a name, a DataFrame function and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        # zoneless timestamps become instants in the session's UTC
        return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def query(sql: str | None = None):
    """Registers f(tables) under its name."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def role(c: str = "role") -> Column:
    return F.when(F.col(c) == "user", "client").when(F.col(c) == "assistant", "manager").otherwise("unknown")


def messages(t: Tables) -> DataFrame:
    """Conversations as messages: thread, seq, role, text."""
    return t.conversations.select(F.col("conv_id").alias("thread"), F.col("turn").alias("seq"), role().alias("role"), "text")


MESSAGES = """messages AS (SELECT conv_id AS thread, turn AS seq, CASE role WHEN 'user' THEN 'client' WHEN 'assistant' THEN 'manager' ELSE 'unknown' END AS role, text FROM conversations)"""
