"""What several operators share."""

from pyspark.sql import DataFrame

from canopyspark.shared import components, cut, hot_keys, join_each, scratch, shared_dir, stable

__all__ = ["bounded", "components", "cut", "hot_keys", "join_each", "scratch", "shared_dir", "stable"]

#: Bytes of an Arrow batch, if the session allows more; a batch ends with the row that reaches them.
BATCH_BYTES = 4 << 20


def bounded(texts: DataFrame) -> DataFrame:
    """``texts``, after the session's Arrow batches are limited to BATCH_BYTES, so that thousands of long texts do not meet in one.

    The setting stays, because plans that have not run yet need it.
    """
    spark = texts.sparkSession
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return texts
