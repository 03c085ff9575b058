"""Job bookkeeping: what is complete, what is still to be done, logs, and tables built once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyspark.functions.text import image_name


def complete_captures(images: DataFrame, capture: str = "capture_id", order: str | None = None) -> DataFrame:
    """(capture, n_bands, complete): complete if a capture has as many images as the first one."""
    counts = images.groupBy(capture).agg(F.count("*").alias("n_bands"))
    first = counts.orderBy(order or capture).limit(1).select(F.col("n_bands").alias("wanted"))
    return counts.join(F.broadcast(first)).select(capture, "n_bands", (F.col("n_bands") == F.col("wanted")).alias("complete"))


def pending(captures: DataFrame, outputs: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """The captures whose output does not exist yet, or all of them."""
    return captures if overwrite else captures.join(outputs.select(key), key, "left_anti")


def first_files(files: DataFrame, n: int, path: str = "path") -> DataFrame:
    """The first n files by path: listings have no order of their own."""
    return files.orderBy(path).limit(n)


def appended(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of tables one after the other, by the names of their columns; columns that one lacks are NULL there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def with_files(captures: DataFrame, files: DataFrame, name: str = "image_name", path: str = "path") -> DataFrame:
    """Captures with the files of their bands by name; a capture without files stays, with a NULL path."""
    named = files.withColumn(name, image_name(F.col(path)))
    return captures.join(named, name, "left")


def middle(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The middle row of each group, the upper one of two."""
    by = ", ".join(keys)
    ranked = rows.selectExpr("*", f"row_number() over (partition by {by} order by {order}) as place", f"count(*) over (partition by {by}) as places")
    return ranked.where("place = places div 2 + 1").drop("place", "places")


def job_log(spark: SparkSession, rows: list[tuple], key: str = "id") -> DataFrame:
    """(id or ratio, num_captures, process_time) of what the driver timed."""
    return spark.createDataFrame(rows, f"{key} {'double' if key == 'ratio' else 'int'}, num_captures long, process_time double")


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path, built and written there first if it does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def single(rows: DataFrame, what: str) -> DataFrame:
    """``rows`` if there is exactly one; an error that names what is missing or ambiguous otherwise."""
    n = rows.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} {what}")
    return rows


def capture_table(images: DataFrame) -> DataFrame:
    """One row per capture from its images' metadata: images has (capture_id, path, band, timestamp, latitude, longitude, altitude,
    yaw, pitch, roll, wavelength, irradiance); irradiances become a map by wavelength, as cameras differ in their bands."""
    first = lambda c: F.min_by(c, "band").alias(c)
    return images.groupBy("capture_id").agg(
        *[first(c) for c in ("timestamp", "latitude", "longitude", "altitude", "yaw", "pitch", "roll")],
        F.min_by(image_name(F.col("path")), "band").alias("image_name"),
        F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("wavelength").isNotNull(), F.struct("wavelength", "irradiance"))))).alias("irradiance"),
    )
