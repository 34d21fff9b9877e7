"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality
from .common import table


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score_documents(documents, model)


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
SQL: dict[str, str] = {}
