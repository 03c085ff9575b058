"""No task of the near-duplicate stage needs two Python workers: executors keep each, and its memory."""

import corpus_pipeline as pipeline

from canopyspark.llm import simhash


def test_simhash_reads_texts_without_python_before_it(spark, monkeypatch):
    asked, near = [], simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs: asked.append(docs._jdf.queryExecution().executedPlan().toString()) or near(docs))
    docs = spark.createDataFrame([(k, f"a b c d e f g h {k % 3}") for k in range(9)], "doc_id long, text string")
    assert sorted(x.doc_id for x in pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 1, 2]
    assert asked and not any("MapInArrow" in plan for plan in asked)
