"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's ``docs``.

1. toxicity: documents that score 0.5 or more go; every other row stays as it is.
2. near duplicates: of each group linked by word five-shingles at a similarity of 0.8, the document with the smallest id
   stays; documents without words are linked with nothing and stay.
3. secrets: every span found is replaced by a mark in the text, and n_chars follows; no row goes.
4. mixing: rows appear as often as the mix takes them: not at all, once or twice.
5. packing: the pieces of the packed sequences.

Columns besides those of ``documents`` pass through untouched up to the last stage. Null texts count as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import jaccard, mixing, packing, secrets, toxicity
from foliospark.llm.common import SESSION, shared_dir, table
from foliospark.session import in_small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return jaccard.one_of_each(docs, size=5, num=80, den=100)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity is learnt and token ids come from a vocabulary: SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{SESSION}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
