"""Round trips through files: what is written and read back must be what the tables say."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyspark.functions import geometry, text
from canopyspark.functions.numeric import rounded
from canopyspark.operators import jobs, spatial
from canopyspark.plans.queries import query
from canopyspark.plans.views import view, with_views
from canopyspark.shared import scratch
from canopyspark.sources import tables, tiff

#: Pixels of a side of an area's image, metres of a pixel and the value of no data.
SIDE, METRES, NODATA = 8, 0.5, 65535.0
DIGITS = "(aoi_id * 7 + k * 131 + b * 977) % 3000"


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of five bands per area, as the writer takes it."""

    def run(parts):
        k = np.arange(SIDE * SIDE)
        for frame in parts:
            rows = []
            for a, x, y in zip(frame.aoi_id, frame.ax, frame.ay, strict=True):
                image = np.stack([(int(a) * 7 + k * 131 + b * 977) % 3000 for b in range(5)]).astype("<f8")
                image[0, int(a) % (SIDE * SIDE)] = NODATA
                rows.append((f"area_{a}.tif", SIDE, SIDE, 5, NODATA, [METRES, 0.0, x, 0.0, -METRES, y], 32616, image.tobytes()))
            yield pd.DataFrame(rows, columns=["path", "rows", "cols", "bands", "nodata", "transform", "epsg", "image"])

    areas = view(spark, sf_dir, "areas").select("aoi_id", "ax", "ay").repartition(4 * spark.sparkContext.defaultParallelism)  # few bytes, many files
    return areas.mapInPandas(run, "path string, rows int, cols int, bands int, nodata double, transform array<double>, epsg int, image binary")


def stack_sql(where: str = "") -> str:
    bands = ", ".join(f"max(d) filter (b = {b}) as d{b + 1}" for b in range(5))
    return with_views(
        f", p as (select aoi_id, ax, ay, k, b, case when b = 0 and k = aoi_id % {SIDE * SIDE} then {NODATA}::double else ({DIGITS})::double end as d from areas, range({SIDE * SIDE}) t(k), range(5) u(b)), "
        f"q as (select aoi_id, (k // {SIDE})::int as \"row\", (k % {SIDE})::int as col, ax + (k % {SIDE} + 0.5) * {METRES}::double as x, ay - (k // {SIDE} + 0.5) * {METRES}::double as y, "
        f"{bands}, {NODATA}::double as nodata, 32616 as epsg from p group by aoi_id, ax, ay, k) select * from q {where}",
        "areas",
    )


def written(spark: SparkSession, sf_dir: str, compression: str, dtype: str) -> str:
    tiff.register(spark)
    path = scratch(spark, "tiff")
    stacks(spark, sf_dir).write.format("field_tiff").option("compression", compression).option("dtype", dtype).mode("overwrite").save(path)
    return path


def exploded(images: DataFrame) -> DataFrame:
    images = images.withColumn("aoi_id", F.regexp_extract("path", r"area_(\d+)\.tif$", 1).cast("int"))
    return tiff.explode_pixels(images, ["aoi_id", "nodata", "epsg"])


@query(stack_sql())
def tiff_stacks_lzw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks written with LZW, found by a glob, and read with their transform, reference system and no-data value."""
    return exploded(spark.read.format("field_tiff").option("pathGlobFilter", "area_*.tif").load(written(spark, sf_dir, "lzw", "uint16")))


@query(stack_sql())
def tiff_stacks_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without compression, as floats, read in windows of two rows."""
    path = written(spark, sf_dir, "none", "float32")
    return exploded(spark.read.format("field_tiff").option("window_bytes", 2 * 8 * 5 * SIDE).load(path))


@query(stack_sql("where x + 0.25 > 500300 and x - 0.25 < 500701.25 and y + 0.25 > 4470199 and y - 0.25 < 4470800.5"))
def tiff_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what touches a box on the ground is read."""
    path = written(spark, sf_dir, "deflate", "uint16")
    return exploded(spark.read.format("field_tiff").option("bbox", "500300,4470199,500701.25,4470800.5").load(path))


@query(with_views(f" select aoi_id, {SIDE} as \"rows\", {SIDE} as cols, 5 as bands, {NODATA}::double as nodata, ax as x0, ay as y0 from areas", "areas"))
def tiff_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What headers say, without a pixel read."""
    images = spark.read.format("field_tiff").option("pixels", "false").load(written(spark, sf_dir, "deflate", "uint16"))
    area = F.regexp_extract("path", r"area_(\d+)\.tif$", 1).cast("int")
    return images.select(area.alias("aoi_id"), "rows", "cols", "bands", "nodata", F.col("transform")[2].alias("x0"), F.col("transform")[5].alias("y0"))


@query(with_views(" select aoi_id, ax / 10000 as longitude, ay / 100000 as latitude from areas", "areas"))
def centres_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of areas from a CSV with ids."""
    path = scratch(spark, "centres")
    view(spark, sf_dir, "areas").selectExpr("aoi_id as Point_ID", "ay / 100000 as Latitude", "ax / 10000 as Longitude").write.option("header", True).csv(path)
    return tables.read_centres(spark, path)


@query(with_views(" select aoi_id, n, x1 + case when n = 2 then x2 - x1 when n = 3 then x3 - x1 when n = 4 then x4 - x1 when n = 5 then x5 - x1 else 0 end as x from polygons, range(1, 6) t(n)", "polygons"))
def polygons_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of areas through a GeoJSON of polygons, a file per area."""
    path = scratch(spark, "polygons")
    ring = F.array(*[F.array(f"x{k}", f"y{k}") for k in (1, 2, 3, 4, 5, 1)])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("aoi_id").alias("id")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    one = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))
    view(spark, sf_dir, "polygons").select("aoi_id", one.alias("value")).repartition(8, "aoi_id").write.partitionBy("aoi_id").text(path)
    read = tables.read_polygons(spark, path)
    return read.select("aoi_id", F.posexplode("ring").alias("n", "p")).select("aoi_id", (F.col("n") + 1).cast("long").alias("n"), F.col("p.x").alias("x"))


@query(with_views(", c as (select *, cap_id % 50 as grp from captures) select grp::bigint as grp, cap_id::varchar as capture_id, 'IMG_' || cap_id as image_name, altitude, yaw, pitch, roll, cx / 10000 as longitude, cy / 100000 as latitude, timestamp '2024-05-01 10:00:00' + to_seconds(cap_id) as timestamp from c", "captures"))
def captures_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture tables through GeoJSON collections, one for each group; times are UTC."""
    path = scratch(spark, "captures")
    rows = view(spark, sf_dir, "captures").selectExpr(
        "cap_id % 50 as grp", "cast(cap_id as string) as capture_id", "concat('IMG_', cap_id) as image_name", "altitude", "yaw as `dls-yaw`", "pitch as `dls-pitch`", "roll as `dls-roll`",
        "cx / 10000 as longitude", "cy / 100000 as latitude", "timestamp '2024-05-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, cap_id) as timestamp",
    )
    tables.write_collections(rows, path, ["timestamp", "altitude", "capture_id", "image_name", "`dls-yaw`", "`dls-pitch`", "`dls-roll`"], "longitude", "latitude", "grp")
    return tables.read_captures(spark, path).withColumn("grp", F.col("capture_id").cast("long") % 50)


@query(with_views(" select aoi_id, (ax - 500000) / 8 as canopy_cover, case when aoi_id % 3 = 0 then null else ay / 8 end as ndvi_mean from areas", "areas"))
def features_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table through one sorted CSV with empty fields for missing values."""
    path = scratch(spark, "features")
    tables.write_features(view(spark, sf_dir, "areas").selectExpr("aoi_id", "(ax - 500000) / 8 as canopy_cover", "case when aoi_id % 3 = 0 then null else ay / 8 end as ndvi_mean"), path)
    return spark.read.schema("aoi_id int, canopy_cover double, ndvi_mean double").option("header", True).csv(path)


@query(with_views(" select aoi_id as id, (aoi_id % 40)::bigint as num_captures, aoi_id / 4.0::double as process_time from areas union all select aoi_id + 100000, 0, 0.5::double from areas", "areas"))
def job_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs appended to each other, through one CSV."""
    path = scratch(spark, "log")
    first = view(spark, sf_dir, "areas").selectExpr("aoi_id as id", "cast(aoi_id % 40 as bigint) as num_captures", "aoi_id / cast(4 as double) as process_time")
    second = first.selectExpr("id + 100000 as id", "0L as num_captures", "cast(0.5 as double) as process_time")
    tables.write_log(jobs.appended(first, second), path)
    return spark.read.schema("id int, num_captures long, process_time double").option("header", True).csv(path)


@query(with_views(" select aoi_id % 5 as band, 9 as n, (aoi_id % 7)::float as shift, 1.0::float as corner from areas where aoi_id % 2 = 1", "areas"))
def matrix_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment matrices of one camera, from a cache that is built once."""
    path = scratch(spark, "matrices")
    rows = view(spark, sf_dir, "areas").selectExpr("concat('camera', aoi_id % 2) as camera_serial", "aoi_id % 5 as band", "array(1D, 0D, cast(aoi_id % 7 as double), 0D, 1D, 0D, 0D, 0D, 1D) as h")
    tables.write_matrices(rows, path)
    return tables.read_matrices(spark, path, "camera1").select("band", F.size("h").alias("n"), F.col("h")[2].alias("shift"), F.col("h")[8].alias("corner"))


@query(with_views(" select id, label from chunk_labels where label = 'AOI_7_ratio_0.05'", "chunk_labels"))
def chunk_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one labelled chunk of a project that is built where it does not exist and then only opened."""
    path = scratch(spark, "project")
    build = lambda: view(spark, sf_dir, "chunk_labels")
    jobs.read_or_build(spark, path, build)
    return tables.chunk(jobs.read_or_build(spark, path, build), "AOI_7_ratio_0.05")


@query(with_views(", f as (select aoi_id, min(id) as first_seen from (select try_cast(split_part(label, '_', 2) as int) as aoi_id, id from chunk_labels) where aoi_id is not null group by aoi_id) select aoi_id, (row_number() over (order by first_seen) - 1)::int as position from f", "chunk_labels"))
def areas_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct areas in the order in which they are first seen."""
    labels = view(spark, sf_dir, "chunk_labels").withColumn("aoi_id", text.label_aoi(F.col("label"))).where("aoi_id is not null")
    return spatial.first_seen(labels, "aoi_id", "id")


@query(with_views(", f as (select 'IMG_' || cap_id as image_name, k as band, 'set/IMG_' || cap_id || '_' || k || '.tif' as path from captures, range(1, 6) t(k) where (cap_id + k) % 9 <> 0) select cap_id, count(path)::bigint as n_files, min(path) as first_file from captures left join f on f.image_name = 'IMG_' || cap_id group by cap_id", "captures"))
def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with the files that are there of them, by name."""
    c = view(spark, sf_dir, "captures").select("cap_id", F.concat(F.lit("IMG_"), F.col("cap_id").cast("string")).alias("image_name"))
    files = c.select("image_name", "cap_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).where("(cap_id + k) % 9 <> 0")
    files = files.select(F.concat(F.lit("set/"), text.band_file(F.col("image_name"), F.col("k"))).alias("path"))
    return jobs.with_files(c, files).groupBy("cap_id").agg(F.count("path").alias("n_files"), F.min("path").alias("first_file"))


@query(with_views(" select (cap_id % 20)::bigint as camera, max(greatest(0, (cap_id % 50)))::double as left, max(greatest(0, cap_id % 30))::double as top, 1280 + min(least(0, cap_id % 50))::double as right, 960 + min(least(0, cap_id % 30))::double as bottom from captures group by cap_id % 20", "captures"))
def crop_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all bands of a camera see when each is moved."""
    h = F.expr("array(1D, 0D, cast(cap_id % 50 as double), 0D, 1D, cast(cap_id % 30 as double), 0D, 0D, 1D)")
    m = view(spark, sf_dir, "captures").select((F.col("cap_id") % 20).alias("camera"), h.alias("h"))
    return geometry.crop_bounds(m, ["camera"], 1280, 960).select("camera", *[rounded(F.col(c), 6).alias(c) for c in ("left", "top", "right", "bottom")])
