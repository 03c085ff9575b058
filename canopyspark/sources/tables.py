"""Tables from CSV and GeoJSON with fixed schemas, and the files that results are written to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<type:string,coordinates:array<double>>"
POLYGON = "struct<type:string,coordinates:array<array<array<double>>>>"
CAPTURE = (
    "timestamp:timestamp,altitude:double,capture_id:string,image_name:string,"
    "`dls-yaw`:double,`dls-pitch`:double,`dls-roll`:double,yaw:double,pitch:double,roll:double"
)


def read_centres(spark: SparkSession, path: str) -> DataFrame:
    """(aoi_id, latitude, longitude) of a CSV with Latitude, Longitude and maybe Point_ID; without ids, positions from 0.

    Ids are keys, not positions, wherever they are used.
    """
    raw = spark.read.option("header", True).csv(path)
    if "Point_ID" in raw.columns:
        number = F.col("Point_ID").cast("int")
    else:  # the file of areas is small and read by one task, so the generated numbers are positions
        raw, number = raw.coalesce(1), F.monotonically_increasing_id().cast("int")
    return raw.select(number.alias("aoi_id"), F.col("Latitude").cast("double").alias("latitude"), F.col("Longitude").cast("double").alias("longitude"))


def _collection(spark: SparkSession, path: str, properties: str, geometry: str) -> DataFrame:
    schema = f"features array<struct<properties:struct<{properties}>,geometry:{geometry}>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(aoi_id, ring) of a GeoJSON of polygons with an id; the ring is the outer one, its closing point left out."""
    rows = _collection(spark, path, "id:int", POLYGON).select(F.col("f.properties.id").alias("aoi_id"), F.col("f.geometry.coordinates")[0].alias("points"))
    ring = F.transform("points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    closed = F.element_at("points", 1) == F.element_at("points", -1)
    return rows.select("aoi_id", F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring).alias("ring"))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The capture table of a GeoJSON of points; attitude columns are named yaw, pitch and roll whichever way they were written."""
    f = _collection(spark, path, CAPTURE, POINT).select("f.properties.*", "f.geometry.coordinates")
    turned = {n: F.coalesce(F.col(n), F.col(f"`dls-{n}`")) for n in ("yaw", "pitch", "roll")}
    return f.select(
        "timestamp", F.col("coordinates")[1].alias("latitude"), F.col("coordinates")[0].alias("longitude"), "altitude", "capture_id", "image_name", *[c.alias(n) for n, c in turned.items()]
    )


def feature_json(properties: list[str], x: str, y: str) -> F.Column:
    """A GeoJSON feature of a point."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))


def write_geojson(rows: DataFrame, path: str, properties: list[str], x: str, y: str, by: str | None = None) -> None:
    """Features, one on each line, in a folder per value of ``by``."""
    lines = rows.select(*([by] if by else []), feature_json(properties, x, y).alias("value"))
    (lines.write.partitionBy(by) if by else lines.write).mode("overwrite").text(path)


def write_collections(rows: DataFrame, path: str, properties: list[str], x: str, y: str, by: str) -> None:
    """One GeoJSON collection for each value of ``by``: a file that holds the few features of one area."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    whole = rows.groupBy(by).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    whole.write.mode("overwrite").partitionBy(by).text(path)


def write_features(features: DataFrame, path: str) -> None:
    """The feature table as one sorted CSV: one row per area, so one file; a missing value is an empty field."""
    features.orderBy("aoi_id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_rasters(rasters: DataFrame, path: str) -> None:
    """Index values per pixel, in folders by area and index."""
    rasters.write.mode("overwrite").partitionBy("aoi_id", "vi").parquet(path)


def write_log(log: DataFrame, path: str) -> None:
    log.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_matrices(spark: SparkSession, path: str, serial: str) -> DataFrame:
    """(band, h) of a camera's alignment matrices."""
    return spark.read.parquet(path).where(F.col("camera_serial") == serial).select("band", "h")


def write_matrices(matrices: DataFrame, path: str) -> None:
    """(camera_serial, band, h array<float> of nine)."""
    matrices.select("camera_serial", "band", F.col("h").cast("array<float>").alias("h")).write.mode("append").parquet(path)


def chunk(rows: DataFrame, label: str) -> DataFrame:
    """The rows of a labelled chunk; an error if there are none."""
    found = rows.where(F.col("label") == label)
    if found.isEmpty():
        raise ValueError(f"no chunk is labelled {label!r}")
    return found
