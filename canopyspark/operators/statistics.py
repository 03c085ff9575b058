"""Masked and raw statistics of vegetation indices per area of interest.

One row per pixel and index is made inside the scan's stage and summed there: what is shuffled is a partial
aggregate per area, index and task, whatever the number of pixels. Where areas are so many that a task sees few pixels of each,
dealt() brings the pixels of an area together first, which is less than their partial aggregates. Missing pixels are NULL and drop out of
every aggregate; an area with nothing to sum has NULL statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyspark.functions import vegetation as V
from canopyspark.shared import hot_keys

DIGITAL = ["d1", "d2", "d3", "d4", "d5"]
STATISTICS = ["mean", "std", "min", "max"]
KEYS = ["aoi_id", "latitude", "longitude", "canopy_cover", "total_pixels", "vegetation_pixels"]


def reflectances(pixels: DataFrame, nodata: float | None = 65535, digital: list[str] = DIGITAL) -> DataFrame:
    """``pixels`` with b1..b5, nodata and vegetation; digital names the columns in the order blue, green, red, red edge, near infrared."""
    bands = pixels.withColumns({b: V.reflectance(d) for b, d in zip(V.BANDS, digital, strict=True)} | {"nodata": V.is_nodata(digital, nodata)})
    return bands.withColumn("vegetation", ~F.col("nodata") & V.is_vegetation())


def index_rows(bands: DataFrame, keys: list[str], indices: list[str] | None = None) -> DataFrame:
    """(keys, vi, x, nodata, vegetation): a row per pixel and index, x being NULL in no-data pixels."""
    names = list(V.INDICES) if indices is None else indices
    # one expression per index and the masks as columns: the generated code stays small enough to be compiled
    long = bands.select(*keys, "nodata", "vegetation", F.inline(F.array(*[F.struct(F.lit(V.key(n)).alias("vi"), V.index(n).cast("double").alias("value")) for n in names])))
    return long.select(*keys, "vi", F.when(~F.col("nodata"), F.col("value")).alias("x"), "nodata", "vegetation")


def moments(x: Column, prefix: str) -> list[Column]:
    return [F.avg(x).alias(f"{prefix}_mean"), F.stddev_pop(x).alias(f"{prefix}_std"), F.min(x).alias(f"{prefix}_min"), F.max(x).alias(f"{prefix}_max")]


def statistics(pixels: DataFrame, keys: list[str] | None = None, nodata: float | None = 65535, indices: list[str] | None = None, digital: list[str] = DIGITAL) -> DataFrame:
    """(keys, vi, total_pixels, vegetation_pixels, raw_mean .. raw_max, veg_mean .. veg_max).

    Vegetation and other pixels are summed apart, one set of moments for each row instead of two, and the two parts of
    each index, few against the pixels, are put together afterwards. A stream, which aggregates once, sums both sets.
    """
    keys = keys or ["aoi_id"]
    rows = index_rows(reflectances(pixels, nodata, digital), keys, indices)
    if pixels.isStreaming:
        green = F.when(F.col("vegetation"), F.col("x"))
        return rows.groupBy(*keys, "vi").agg(
            F.count_if(~F.col("nodata")).alias("total_pixels"), F.count_if("vegetation").alias("vegetation_pixels"), *moments(F.col("x"), "raw"), *moments(green, "veg")
        )
    parts = rows.groupBy(*keys, "vi", "vegetation").agg(
        F.count_if(~F.col("nodata")).alias("pixels"), F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    green = lambda c: F.max(F.when(F.col("vegetation"), F.col(c)))
    other = lambda c: F.max(F.when(~F.col("vegetation"), F.col(c)))
    n, weighted = F.sum("n"), F.when(F.col("n") > 0, F.col("n"))
    apart = F.coalesce(green("mean") - other("mean"), F.lit(0.0))
    between = F.coalesce(green("n") * other("n"), F.lit(0)) * apart * apart / F.when(n > 0, n)
    mean = F.sum(weighted * F.col("mean")) / F.when(n > 0, n)
    std = F.sqrt((F.sum(weighted * F.col("var")) + between) / F.when(n > 0, n))
    return parts.groupBy(*keys, "vi").agg(
        F.sum("pixels").alias("total_pixels"), F.coalesce(green("pixels"), F.lit(0)).alias("vegetation_pixels"),
        mean.alias("raw_mean"), std.alias("raw_std"), F.min("min").alias("raw_min"), F.max("max").alias("raw_max"),
        green("mean").alias("veg_mean"), F.sqrt(green("var")).alias("veg_std"), green("min").alias("veg_min"), green("max").alias("veg_max"),
    )


def dealt(pixels: DataFrame, keys: list[str]) -> list[DataFrame]:
    """``pixels`` in one or two parts without common ``keys``: those of keys with many rows as they are, to be summed where they stand, and the others dealt out by keys, whose sums are then made without a further shuffle."""
    hot = hot_keys(pixels.select(*keys), keys)
    if hot is None:
        return [pixels.repartition(*keys)]
    few = F.broadcast(hot)
    return [pixels.join(few, keys, "left_semi"), pixels.join(few, keys, "left_anti").repartition(*keys)]


def mergeable(pixels: DataFrame, keys: list[str], nodata: float | None = 65535, indices: list[str] | None = None) -> DataFrame:
    """Moments in a form that can be stored and merged: (keys, vi, n, mean, m2, min, max), raw and vegetation apart in ``variant``."""
    rows = index_rows(reflectances(pixels, nodata), keys, indices)
    variants = F.inline(F.array(F.struct(F.lit("raw").alias("variant"), F.lit(True).alias("in")), F.struct(F.lit("no_soil").alias("variant"), F.col("vegetation").alias("in"))))
    rows = rows.select(*keys, "vi", "x", variants).where("in and x is not null")
    return rows.groupBy(*keys, "vi", "variant").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"), F.min("x").alias("min"), F.max("x").alias("max")
    )


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of stored moments: (keys, vi, variant, n, mean, std, min, max), as if their pixels were aggregated together.

    The between-part sum of squares needs the total mean, which is told to the parts within their group, so they are shuffled once.
    """
    by = [*keys, "vi", "variant"]
    group = Window.partitionBy(*by)
    told = parts.withColumn("total", F.sum("n").over(group)).withColumn("centre", F.sum(F.col("n") * F.col("mean")).over(group) / F.col("total"))
    off = F.col("mean") - F.col("centre")
    return told.groupBy(*by).agg(
        F.max("total").alias("n"), F.max("centre").alias("mean"),
        F.sqrt(F.sum(F.col("m2") + F.col("n") * off * off) / F.max("total")).alias("std"), F.min("min").alias("min"), F.max("max").alias("max"),
    )


def wide(stats: DataFrame, prefix: str, keys: list[str], indices: list[str] | None = None) -> DataFrame:
    """One row per area with <vi>_mean .. <vi>_max for every index, from the columns that ``prefix`` begins."""
    names = [V.key(n) for n in (list(V.INDICES) if indices is None else indices)]
    columns = [F.max(F.when(F.col("vi") == n, F.col(f"{prefix}_{s}"))).alias(f"{n}_{s}") for n in names for s in STATISTICS]
    return stats.groupBy(*keys).agg(F.max("total_pixels").alias("total_pixels"), F.max("vegetation_pixels").alias("vegetation_pixels"), *columns)


def features(stats: DataFrame, areas: DataFrame, variant: str, layout: str = "aoi", indices: list[str] | None = None) -> DataFrame:
    """The feature table: six keys, then four statistics of each index.

    variant: "no_soil" sums vegetation pixels only, "raw" all valid ones. layout: "aoi" for one mosaic per area and
    "whole" for one mosaic clipped per area leave out areas without a mosaic, "orthorectified" for many photos per area
    keeps them as rows without statistics. areas: (aoi_id, latitude, longitude).

    Fixed choices: raw cover is 1; raw counts are those of valid pixels, but 0 in the orthorectified layout; no valid
    pixel gives no cover, but cover 0 in the orthorectified layout.
    """
    if variant not in ("raw", "no_soil") or layout not in ("aoi", "whole", "orthorectified"):
        raise ValueError(f"no layout {layout!r} of variant {variant!r}")
    many = layout == "orthorectified"
    table = wide(stats, "raw" if variant == "raw" else "veg", ["aoi_id"], indices)
    joined = areas.select("aoi_id", "latitude", "longitude").join(table.withColumn("seen", F.lit(True)), "aoi_id", "left" if many else "inner")
    total, green, seen = F.coalesce("total_pixels", F.lit(0)), F.coalesce("vegetation_pixels", F.lit(0)), F.col("seen").isNotNull()
    zero = F.lit(0).cast("long")
    if variant == "raw":
        cover, counts = F.when(seen, F.lit(1.0)), (zero, zero) if many else (total, total)
    else:
        cover = F.when(total > 0, green / total)
        if many:
            cover = F.when(seen, F.coalesce(cover, F.lit(0.0)))
        counts = total, green
    names = [V.key(n) for n in (list(V.INDICES) if indices is None else indices)]
    return joined.select("aoi_id", "latitude", "longitude", cover.alias("canopy_cover"), counts[0].alias("total_pixels"), counts[1].alias("vegetation_pixels"), *[f"{n}_{s}" for n in names for s in STATISTICS])


def index_rasters(pixels: DataFrame, keys: list[str], nodata: float | None = 65535, indices: list[str] | None = None) -> DataFrame:
    """(keys, vi, value, masked): each index at each pixel as a float, and where it is vegetation; NULL is no data."""
    rows = index_rows(reflectances(pixels, nodata), keys, indices)
    return rows.select(*keys, "vi", F.col("x").cast("float").alias("value"), F.when(F.col("vegetation"), F.col("x")).cast("float").alias("masked"))


def rdvi_range(pixels: DataFrame, keys: list[str], nodata: float | None = 65535) -> DataFrame:
    """(keys, least, most) of RDVI over all pixels, no-data ones included, for the log."""
    return reflectances(pixels, nodata).groupBy(*keys).agg(F.min(V.index("RDVI")).alias("least"), F.max(V.index("RDVI")).alias("most"))
