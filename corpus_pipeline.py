"""From raw documents to packed sequences: each stage calls one operator and works on what the one before kept.

toxicity -> language_id -> near_duplicates -> secret_scan -> packing. A stage takes (spark, docs, sf_dir) and
returns a DataFrame, with the columns of ``documents`` but for the last; it is written as Parquet in the
folder that all executors share and read again as the next one's input, so a lost executor costs no more
than its own tasks. Only the last stage's rows are the result.

Null and empty texts: toxicity scores them clean, the language stage drops them. Empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from canopyspark.llm import langid, packing, secrets, shingles, toxicity
from canopyspark.llm.common import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not predict toxic."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_no_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without any letter go."""
    return langid.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    SimHash components are checked with the whole sets, and what fingerprints cannot tell is found by prefixes.
    """
    return shingles.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that are not widely copied examples replaced."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document: where it stands in which sequence."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_no_language),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: The stages hash, count n-grams, tokenise and pack; SQL cannot express that. Tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
