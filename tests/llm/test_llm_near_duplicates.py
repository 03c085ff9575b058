"""The pipeline's near-duplicates go through the SimHash operator, and its links through an exact check."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from canopyspark.llm import simhash

TEXTS = ["a b c d e f g h i", "A b c d e f g h i", "a b c d e f g h i j", "q r s t u v w", None, "", "k l m n o p q r s t u v w x", "k l m n o p q r s t u v w y"]
ALL = simhash.near_duplicates


@pytest.mark.parametrize("links", [ALL, lambda docs: ALL(docs).withColumn("component_id", F.col("doc_id")), lambda docs: ALL(docs).join(docs.agg(F.min("doc_id").alias("least"))).withColumn("component_id", F.col("least"))])
def test_simhash_is_asked_and_checked(spark, monkeypatch, links):
    """Whatever SimHash links, the groups are those of similar sets."""
    asked = []
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs: asked.append(1) or links(docs))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert sorted(x.doc_id for x in pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 3, 4, 6]
    assert asked
