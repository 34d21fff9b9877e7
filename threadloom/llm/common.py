"""What the operators share: the cluster's shared folder, written intermediates and table access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BATCH_CONF, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master, where it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(context, "_threadloom_dir", None):
        context._threadloom_dir = "file://" + tempfile.mkdtemp(prefix="threadloom-")
    return context._threadloom_dir


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/threadloom/{what}-{uuid.uuid4().hex}"


def trimmed(run: Callable) -> Callable:
    """run, after which the worker gives memory that it no longer uses back to the system, as it lives on for other tasks."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return whole


def mapped(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema). Where the session has Spark's default of rows an Arrow batch, it gets BATCH_ROWS instead: texts are
    long, and either side of a worker's pipe holds whole batches outside the heap."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF) == BATCH_DEFAULT:
        conf.set(BATCH_CONF, str(BATCH_ROWS))
    return df.mapInArrow(trimmed(run), schema)


def written(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, df: DataFrame) -> str:
    """name, longer by underscores until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
