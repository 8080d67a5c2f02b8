"""Awkward documents for every operator."""

import pytest
from pyspark.sql import types as T

#: Null and repeated ids, null, empty and very long texts, copies that differ in case or in one word.
ROWS = [
    (1, "Hello World one two three four"),
    (2, "hello world ONE two three four"),
    (2, "hello world ONE two three four"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (None, "hello world one two three four"),
    (None, "no id at all"),
    (6, "É é ß 日本語 🙂 " * 50),
    (7, "é é ß 日本語 🙂 " * 50),
    (8, "word soup " * 30_000),
    (9, "word soup " * 30_000 + "end"),
    (10, "one"),
    (-11, "a\x01b\x02c"),
    (12, "x" * 5000),
]
#: Names that operators use themselves.
EXTRA = ["keep_id", "kept", "n", "fp", "fingerprint", "score", "length", "_row", "_id", "label", "data", "_pieces", "sequence_id", "offset", "piece", "host", "source"]


@pytest.fixture(scope="session")
def messy(spark):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    schema = T.StructType(fields + [T.StructField(c, T.StringType()) for c in EXTRA])
    return spark.createDataFrame([(*r, *(None if k % 3 else "v" for k, _ in enumerate(EXTRA))) for r in ROWS], schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
