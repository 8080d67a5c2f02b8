"""From raw documents to packed training sequences, five stages in a row."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import exact, packing, quality, secrets, simhash
from linkloom.llm.queries import secret_model
from linkloom.llm.shared import short_batches


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.3 or more."""
    short_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.drop_rejected(docs, model, least=0.3)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, that with the largest doc_id."""
    short_batches(spark)
    return exact.drop_exact(docs, keep="largest")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    short_batches(spark)
    return simhash.drop_near(docs, shingle=3, max_bits=3)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    return secrets.redact(docs, *secret_model(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in their sequences."""
    short_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality", keep_good),
    ("exact", drop_exact),
    ("near", drop_near),
    ("secrets", hide_secrets),
    ("pack", pack),
]

#: A fitted classifier, fingerprints and a tokenizer are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
