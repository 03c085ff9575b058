"""The pipeline's stages on a small corpus: each one's decisions, and what goes through all of them."""

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = []
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append((docs.count(), after.count()))
        docs = after
    assert [a >= b for a, b in sizes] == [True] * 4 and sizes[3][0] == sizes[3][1]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = labels.where("toxic = 0").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    kept = clean.join(spark.read.parquet(f"{tmp_path}/0"), "doc_id", "left_semi").count()
    assert kept >= 0.97 * clean.count()
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == sizes[-1][1]


def test_run(spark):
    sf = SF.replace("0.01", "0.001")
    out = pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
