"""The cluster's shared folder and intermediates written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids that are broadcast at most; beyond, joins are shuffled.
BROADCAST_IDS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_threadloom_folder", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = spark._threadloom_folder = "file://" + tempfile.mkdtemp(prefix="threadloom-")
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, what: str = "cut") -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/threadloom-{what}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, which ends its lineage."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(ids: DataFrame) -> DataFrame:
    """ids, which is stored, with a broadcast hint where it has at most BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
