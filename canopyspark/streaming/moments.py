"""Index statistics that follow photos as they arrive: the state is one set of moments per area and index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from canopyspark.operators.statistics import statistics


def running(pixels: DataFrame, keys: list[str] | None = None, nodata: float | None = 65535, indices: list[str] | None = None) -> DataFrame:
    """statistics() of a stream of pixels; state grows with areas and indices, not with pixels."""
    if not pixels.isStreaming:
        raise ValueError("a stream is needed")
    return statistics(pixels, keys, nodata, indices)


def into_table(stats: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each batch's areas, whole, as a Parquet folder per batch; the last folder that has an area holds its statistics."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stats.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)


def latest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key of what into_table() wrote."""
    by = ", ".join([*keys, "vi"])
    return batches.selectExpr("*", f"row_number() over (partition by {by} order by batch desc) as age").where("age = 1").drop("age", "batch")
