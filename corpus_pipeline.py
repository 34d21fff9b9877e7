"""A training corpus from documents: five stages, each on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

1. quality: documents scored under the classifier's cut go.
2. near_duplicates: of each group of near duplicates (word 5-grams, similarity 0.8) the smallest doc_id stays.
3. secrets: secrets inside texts are masked; every document stays, and n_chars follows its text.
4. mixture: documents by target weights, up to two epochs, so a row may occur twice.
5. tokens: token ids of each row, encoded and decoded, as counts and digests.

Cases: null and empty texts are scored like other texts, have no near duplicates and no secrets, count no tokens and encode to
none; null lang or source is a leaf of its own; rows without a doc_id stay in every stage but are never near duplicates; of rows
that share a doc_id the first by text stays; without labels nothing is rejected; an empty table gives no rows; other columns,
whatever their names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, jaccard, mixing, quality, secrets
from threadloom.llm.common import fresh_path, table
from threadloom.llm.q_mixing import PLAN


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.keep_predicted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, words=5, num=80, den=100)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    words = secrets.dictionary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return secrets.redacted(docs, words=words).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs, PLAN)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, remembered=12 << 20)  # workers hold what the other stages remember as well


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
    ("tokens", encode_tokens),
]

#: The classifier, and tokens, can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
