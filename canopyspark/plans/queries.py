"""The queries of the library over the stand-ins, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyspark.functions import geodesy, geometry, text
from canopyspark.functions.numeric import rounded
from canopyspark.operators import alignment, detailed, graph, jobs, matching, mosaic, spatial, statistics
from canopyspark.plans.views import view, with_views
from canopyspark.shared import scratch
from canopyspark.streaming import moments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Metres of a footprint on the ground, and pixels of an image.
WIDTH_M, HEIGHT_M = 30.0, 22.0
FOCAL, COLS, ROWS = 5.5, 1280, 960


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# DuckDB's side: bands, masks and indices written out once more, by hand
BANDS_SQL = """, bands as (
  select *, (d1 = 65535 or d2 = 65535 or d3 = 65535 or d4 = 65535 or d5 = 65535) as nd,
    d1 / 32768.0::double as b, d2 / 32768.0::double as g, d3 / 32768.0::double as r, d4 / 32768.0::double as e, d5 / 32768.0::double as n from pixels),
masked as (
  select *, not nd and greatest(r, g, b) >= 0.05::double and coalesce(case when n + r > 0 then (n - r) / sqrt(n + r) end >= 0.10::double, false) as veg from bands)"""
INDEX_SQL = {
    "ndvi": "case when n + r <> 0 then (n - r) / (n + r) end",
    "gndvi": "case when n + g <> 0 then (n - g) / (n + g) end",
    "savi": "case when n + r + 0.5::double <> 0 then 1.5::double * (n - r) / (n + r + 0.5::double) end",
    "ndre": "case when n + e <> 0 then (n - e) / (n + e) end",
    "tvi": "0.5::double * (120 * (n - g) - 200 * (r - g))",
    "exg": "2 * g - r - b",
    "sr": "case when r > 0 then n / r end",
    "psri": "case when n > 0 then (r - g) / n end",
    "g": "case when r > 0 then g / r end",
    "rdvi": "case when n + r > 0 then (n - r) / sqrt(n + r) end",
    "mcari2": "case when pow(2 * n + 1, 2) - (6 * n - 5 * sqrt(n)) - 0.5::double > 0 then 1.5::double * (2.5::double * (n - r) - 1.3::double * (n - g)) / sqrt(pow(2 * n + 1, 2) - (6 * n - 5 * sqrt(n)) - 0.5::double) end",
    "grvi": "case when g + r <> 0 then (g - r) / (g + r) end",
    "red": "r", "green": "g", "blue": "b", "rededge": "e", "nir": "n",
    "osavi": "case when n + r + 0.16::double <> 0 then 1.16::double * (n - r) / (n + r + 0.16::double) end",
}
LONG_SQL = ", long as (" + " union all ".join(f"select aoi_id, photo_id, px, nd, veg, '{k}' as vi, case when not nd then {x} end as x from masked" for k, x in INDEX_SQL.items()) + ")"
R6 = "round({}, 6) + 0.0::double as {}"


def stats_sql(keys: str) -> str:
    parts = [R6.format(f"{f}(case when {c} then x end)", f"{p}_{s}") for p, c in (("raw", "true"), ("veg", "veg")) for f, s in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"))]
    return f" select {keys}, vi, count(*) filter (not nd) as total_pixels, count(*) filter (veg) as vegetation_pixels, {', '.join(parts)} from long group by {keys}, vi"


def at_six(stats: DataFrame) -> DataFrame:
    return stats.select(*[rounded(F.col(c), 6).alias(c) if k == "double" else F.col(c) for c, k in stats.dtypes])


@query(with_views(BANDS_SQL + LONG_SQL + stats_sql("aoi_id"), "pixels"))
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_six(statistics.statistics(view(spark, sf_dir, "pixels")))


@query(with_views(BANDS_SQL + LONG_SQL + stats_sql("aoi_id, photo_id"), "pixels"))
def index_statistics_by_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_six(statistics.statistics(view(spark, sf_dir, "pixels"), ["aoi_id", "photo_id"]))


@query(
    with_views(
        BANDS_SQL + ", ndvi as (select aoi_id, nd, veg, case when not nd then " + INDEX_SQL["ndvi"] + " end as x from masked) select aoi_id, count(*) filter (not nd) as total_pixels, "
        "count(*) filter (veg) as vegetation_pixels, round(count(*) filter (veg) / nullif(count(*) filter (not nd), 0)::double, 6) + 0.0::double as canopy_cover, "
        "round(avg(x), 6) + 0.0::double as raw_mean, round(avg(case when veg then x end), 6) + 0.0::double as veg_mean from ndvi group by aoi_id order by aoi_id",
        "pixels",
    )
)
def canopy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics.statistics(view(spark, sf_dir, "pixels"), indices=["NDVI"])
    cover = F.when(F.col("total_pixels") > 0, F.col("vegetation_pixels") / F.col("total_pixels"))
    return s.select("aoi_id", "total_pixels", "vegetation_pixels", rounded(cover, 6).alias("canopy_cover"), rounded(F.col("raw_mean"), 6).alias("raw_mean"), rounded(F.col("veg_mean"), 6).alias("veg_mean")).orderBy("aoi_id")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "areas")
    lon, lat = geodesy.inverse(F.col("ax"), F.col("ay"))
    return a.select("aoi_id", rounded(lat, 6).alias("latitude"), rounded(lon, 6).alias("longitude"))


def sum_sql(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def series_sql(coefficients: list[float], f: str, g: str | None, x: str, y: str = "", weight: bool = False) -> str:
    """Sum of coefficient j times f(2 j x) g(2 j y), and times 2 j if it is a derivative."""
    return sum_sql([f"{2 * j * a if weight else a!r}::double * {f}({2 * j} * {x})" + (f" * {g}({2 * j} * {y})" if g else "") for j, a in enumerate(coefficients, 1)])


def inverse_sql(source: str, x: str, y: str, out: str) -> str:
    """A chain of common table expressions that ends in ``out``: source with lon and lat."""
    k = repr(geodesy._radius) + "::double"
    return (
        f", {out}_1 as (select *, {y} / {k} as xi_, ({x} - 500000) / {k} as eta_ from {source}), "
        f"{out}_2 as (select *, xi_ - {series_sql(geodesy.BETA, 'sin', 'cosh', 'xi_', 'eta_')} as u_, eta_ - {series_sql(geodesy.BETA, 'cos', 'sinh', 'xi_', 'eta_')} as v_ from {out}_1), "
        f"{out}_3 as (select *, asin(sin(u_) / cosh(v_)) as chi_ from {out}_2), "
        f"{out} as (select * exclude (xi_, eta_), -87 + degrees(atan2(sinh(v_), cos(u_))) as lon, degrees(chi_ + {series_sql(geodesy.DELTA, 'sin', None, 'chi_')}) as lat from {out}_3)"
    )


def sphere_sql(source: str, out: str) -> str:
    """The same for the sphere's coordinates of lon and lat: t, lam, xi and eta."""
    c = repr(geodesy._c) + "::double"
    return (
        f", {out}_1 as (select *, sin(radians(lat)) as s_, radians(lon + 87) as lam from {source}), {out}_2 as (select *, sinh(atanh(s_) - {c} * atanh({c} * s_)) as t from {out}_1), "
        f"{out} as (select *, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from {out}_2)"
    )


FORWARD_SQL = (
    f"500000 + {geodesy._radius!r}::double * (eta + {series_sql(geodesy.ALPHA, 'cos', 'sinh', 'xi', 'eta')})",
    f"{geodesy._radius!r}::double * (xi + {series_sql(geodesy.ALPHA, 'sin', 'cosh', 'xi', 'eta')})",
)
CONVERGENCE_SQL = (
    "degrees(atan2(t * sin(lam), sqrt(1 + t * t) * cos(lam)) + "
    f"atan2({series_sql(geodesy.ALPHA, 'sin', 'sinh', 'xi', 'eta', True)}, 1 + {series_sql(geodesy.ALPHA, 'cos', 'cosh', 'xi', 'eta', True)}))"
)
PLACES_SQL = inverse_sql("areas", "ax", "ay", "degrees_of") + ", places as (select aoi_id, round(lat, 6) + 0.0::double as latitude, round(lon, 6) + 0.0::double as longitude from degrees_of)"


def features_sql(variant: str, layout: str) -> str:
    many, raw = layout == "orthorectified", variant == "raw"
    value = "x" if raw else "case when veg then x end"
    columns = [R6.format(f"{f}(case when vi = '{k}' then {value} end)", f"{k}_{s}") for k in INDEX_SQL for f, s in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"))]
    wide = f", wide as (select aoi_id, count(*) filter (vi = 'ndvi' and not nd) as total, count(*) filter (vi = 'ndvi' and veg) as green, {', '.join(columns)} from long group by aoi_id)"
    total, green = ("0::bigint", "0::bigint") if raw and many else ("coalesce(total, 0)", "coalesce(total, 0)") if raw else ("coalesce(total, 0)", "coalesce(green, 0)")
    cover = "case when wide.aoi_id is not null then 1.0::double end" if raw else "case when wide.aoi_id is not null then coalesce(green / nullif(total, 0)::double, 0) end" if many else "green / nullif(total, 0)::double"
    names = ", ".join(f"{k}_{s}" for k in INDEX_SQL for s in ("mean", "std", "min", "max"))
    return with_views(
        BANDS_SQL + LONG_SQL + PLACES_SQL + wide + f" select places.aoi_id, latitude, longitude, round({cover}, 6) + 0.0::double as canopy_cover, {total} as total_pixels, {green} as vegetation_pixels, {names} "
        f"from places {'left' if many else ''} join wide on places.aoi_id = wide.aoi_id order by places.aoi_id",
        "pixels", "areas",
    )


def feature_query(variant: str, layout: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        stats = statistics.statistics(view(spark, sf_dir, "pixels"))
        table = statistics.features(stats, positions(spark, sf_dir), variant, layout)
        return at_six(table).orderBy("aoi_id")

    f.__name__ = f"features_{layout}_{variant}"
    query(features_sql(variant, layout))(f)


for _layout in ("aoi", "whole", "orthorectified"):
    for _variant in ("no_soil", "raw"):
        feature_query(_variant, _layout)


@query(with_views(BANDS_SQL + LONG_SQL + " select aoi_id, photo_id, px, vi, round(x, 9) + 0.0::double as value, round(case when veg then x end, 9) + 0.0::double as masked from long where vi in ('ndvi', 'mcari2')", "pixels"))
def index_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = view(spark, sf_dir, "pixels")
    rows = statistics.index_rows(statistics.reflectances(pixels), ["aoi_id", "photo_id", "px"], ["NDVI", "MCARI2"])
    return rows.select("aoi_id", "photo_id", "px", "vi", rounded(F.col("x"), 9).alias("value"), rounded(F.when(F.col("vegetation"), F.col("x")), 9).alias("masked"))


@query(
    with_views(
        BANDS_SQL + LONG_SQL + ", variants as (select aoi_id, vi, 'raw' as variant, x from long union all select aoi_id, vi, 'no_soil', x from long where veg) select aoi_id, vi, variant, count(x)::bigint as n, "
        + ", ".join(R6.format(f"{f}(x)", s) for f, s in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"))) + " from variants where x is not null group by aoi_id, vi, variant",
        "pixels",
    )
)
def merged_photo_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of each photo, merged per area."""
    pixels = view(spark, sf_dir, "pixels").drop("px")
    found = [statistics.merged(statistics.mergeable(part, ["aoi_id", "photo_id"]), ["aoi_id"]) for part in statistics.dealt(pixels, ["aoi_id"])]
    return at_six(reduce(DataFrame.unionByName, found))


@query(with_views(BANDS_SQL + f" select aoi_id, round(min({INDEX_SQL['rdvi']}), 6) + 0.0::double as least, round(max({INDEX_SQL['rdvi']}), 6) + 0.0::double as most from masked group by aoi_id", "pixels"))
def rdvi_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_six(statistics.rdvi_range(view(spark, sf_dir, "pixels"), ["aoi_id"]))


@query(with_views(BANDS_SQL + LONG_SQL + stats_sql("aoi_id").replace(" from long", " from long where vi in ('ndvi', 'sr')"), "pixels"))
def streamed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics by a stream that reads the table as photos that arrive."""
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/lineitem.parquet*")
    pixels = stream.selectExpr(*PIXEL_COLUMNS)
    path = scratch(spark, "stream")
    stats = moments.running(pixels, indices=["NDVI", "SR"])
    run = moments.into_table(stats, f"{path}/out", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return at_six(moments.latest(spark.read.parquet(f"{path}/out"), ["aoi_id"]))


def _columns(sql: str) -> list[str]:
    """The select list of a one-table stand-in."""
    body = sql.strip()[len("select") : sql.strip().rindex("\nfrom")]
    parts, depth, held = [], 0, ""
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(held)
            held = ""
        else:
            held += c
    return [" ".join(p.split()) for p in [*parts, held]]


def _pixel_columns() -> list[str]:
    from canopyspark.plans.views import PIXELS

    return _columns(PIXELS)


PIXEL_COLUMNS = _pixel_columns()

# areas and captures
BOX_SQL = f", boxes as (select aoi_id, ratio, ax - 18 - (0.5::double - ratio) * {WIDTH_M} as xmin, ax + 18 + (0.5::double - ratio) * {WIDTH_M} as xmax, ay - 18 - (0.5::double - ratio) * {HEIGHT_M} as ymin, ay + 18 + (0.5::double - ratio) * {HEIGHT_M} as ymax from areas, ratios)"
INSIDE_SQL = "cx > xmin and cx < xmax and cy > ymin and cy < ymax"


@query(with_views(", ratios as (select 0.05::double as ratio)" + BOX_SQL + f" select aoi_id, cap_id, cx, cy from boxes join captures on {INSIDE_SQL}", "areas", "captures"))
def captures_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spatial.aoi_boxes(view(spark, sf_dir, "areas"), 0.05, WIDTH_M, HEIGHT_M)
    return spatial.points_in_boxes(view(spark, sf_dir, "captures").select("cap_id", "cx", "cy"), boxes).select("aoi_id", "cap_id", "cx", "cy")


@query(with_views(", ratios as (select 0.05::double as ratio)" + BOX_SQL + f" select aoi_id, count(cap_id)::bigint as n_captures from boxes left join captures on {INSIDE_SQL} group by aoi_id", "areas", "captures"))
def capture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spatial.aoi_boxes(view(spark, sf_dir, "areas"), 0.05, WIDTH_M, HEIGHT_M)
    return spatial.counts_in_boxes(view(spark, sf_dir, "captures"), boxes, ["aoi_id"])


@query(
    with_views(
        ", ratios as (select round(k * 0.05::double, 2) as ratio from range(1, 11) t(k))" + BOX_SQL + f" select aoi_id, ratio, printf('AOI_%d_ratio_%.2f', aoi_id, ratio) as label, count(cap_id)::bigint as n_captures "
        f"from boxes left join captures on {INSIDE_SQL} group by aoi_id, ratio",
        "areas", "captures",
    )
)
def ratio_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = spatial.aoi_boxes(view(spark, sf_dir, "areas").withColumn("ratio", F.explode(text.ratio_grid())), F.col("ratio"), WIDTH_M, HEIGHT_M)
    counts = spatial.counts_in_boxes(view(spark, sf_dir, "captures"), grown, ["aoi_id", "ratio"])
    return counts.select("aoi_id", "ratio", text.chunk_label(F.col("aoi_id"), F.col("ratio")).alias("label"), "n_captures")


EDGES_SQL = ", edges as (" + " union all ".join(f"select aoi_id, ax, ay, x{k} as px_, y{k} as py_, x{k % 5 + 1} as qx, y{k % 5 + 1} as qy from polygons" for k in range(1, 6)) + ")"


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(1, 6)])
    return view(spark, sf_dir, "polygons").select("aoi_id", ring.alias("ring"))


@query(
    with_views(
        EDGES_SQL + ", near as (select aoi_id, ax, ay, px_ - ax as a, py_ - ay as b, qx - ax as c, qy - ay as d from edges) "
        "select aoi_id, min(a + ax) as xmin, min(b + ay) as ymin, max(a + ax) as xmax, max(b + ay) as ymax, round(sum(a * d - c * b) / 2, 3) as area, "
        "round(ax + sum((a + c) * (a * d - c * b)) / (3 * sum(a * d - c * b)), 3) as cx, round(ay + sum((b + d) * (a * d - c * b)) / (3 * sum(a * d - c * b)), 3) as cy from near group by aoi_id, ax, ay",
        "polygons",
    )
)
def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rings(spark, sf_dir)
    b = geometry.ring_bounds(F.col("ring"))
    cx, cy = geometry.ring_centroid(F.col("ring"))
    return p.select("aoi_id", *[c.alias(n) for n, c in b.items()], F.round(geometry.ring_area(F.col("ring")), 3).alias("area"), F.round(cx, 3).alias("cx"), F.round(cy, 3).alias("cy"))


CROSS_SQL = "count(*) filter ((py_ > y) <> (qy > y) and x < px_ + (y - py_) * (qx - px_) / case when qy <> py_ then qy - py_ else 1 end) % 2 = 1"
TOUCH_SQL = (
    "count(*) filter (least(px_, qx) <= x + 0.5 and greatest(px_, qx) >= x - 0.5 and least(py_, qy) <= y + 0.5 and greatest(py_, qy) >= y - 0.5 and "
    "least((x - 0.5 - px_) * (qy - py_) - (y - 0.5 - py_) * (qx - px_), (x - 0.5 - px_) * (qy - py_) - (y + 0.5 - py_) * (qx - px_), (x + 0.5 - px_) * (qy - py_) - (y - 0.5 - py_) * (qx - px_), (x + 0.5 - px_) * (qy - py_) - (y + 0.5 - py_) * (qx - px_)) <= 0 and "
    "greatest((x - 0.5 - px_) * (qy - py_) - (y - 0.5 - py_) * (qx - px_), (x - 0.5 - px_) * (qy - py_) - (y + 0.5 - py_) * (qx - px_), (x + 0.5 - px_) * (qy - py_) - (y - 0.5 - py_) * (qx - px_), (x + 0.5 - px_) * (qy - py_) - (y + 0.5 - py_) * (qx - px_)) >= 0) > 0"
)


@query(with_views(EDGES_SQL + f" select aoi_id, px, x, y from edges join grid on x between ax - 20 and ax + 20 and y between ay - 20 and ay + 20 group by aoi_id, px, x, y having {CROSS_SQL}", "polygons", "grid"))
def pixels_inside_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.pixels_in_polygons(view(spark, sf_dir, "grid"), rings(spark, sf_dir), 50.0, all_touched=False).select("aoi_id", "px", "x", "y")


@query(with_views(EDGES_SQL + f" select aoi_id, px, x, y from edges join grid on x between ax - 20 and ax + 20 and y between ay - 20 and ay + 20 group by aoi_id, px, x, y having {CROSS_SQL} or {TOUCH_SQL}", "polygons", "grid"))
def pixels_touching_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.pixels_in_polygons(view(spark, sf_dir, "grid"), rings(spark, sf_dir), 50.0).select("aoi_id", "px", "x", "y")


# projection and camera

@query(with_views(inverse_sql("captures", "cx", "cy", "d") + " select cap_id, round(lon, 7) + 0.0::double as longitude, round(lat, 7) + 0.0::double as latitude from d", "captures"))
def positions_to_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = geodesy.inverse(F.col("cx"), F.col("cy"))
    return view(spark, sf_dir, "captures").select("cap_id", rounded(lon, 7).alias("longitude"), rounded(lat, 7).alias("latitude"))


DEGREES_SQL = ", places as (select cap_id, -87 + (cap_id % 500 - 250) * 0.01::double as lon, 38 + (cap_id % 700) * 0.01::double as lat from captures)"
DEGREES = {"lon": "-87 + (cap_id % 500 - 250) * cast(0.01 as double)", "lat": "38 + (cap_id % 700) * cast(0.01 as double)"}


@query(with_views(DEGREES_SQL + sphere_sql("places", "p") + f" select cap_id, round({FORWARD_SQL[0]}, 3) + 0.0::double as easting, round({FORWARD_SQL[1]}, 3) + 0.0::double as northing from p", "captures"))
def degrees_to_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "captures").selectExpr("cap_id", *[f"{e} as {n}" for n, e in DEGREES.items()])
    east, north = geodesy.forward(F.col("lon"), F.col("lat"))
    return p.select("cap_id", rounded(east, 3).alias("easting"), rounded(north, 3).alias("northing"))


@query(with_views(DEGREES_SQL + sphere_sql("places", "p") + f" select cap_id, round({CONVERGENCE_SQL}, 6) + 0.0::double as convergence from p", "captures"))
def meridian_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "captures").selectExpr("cap_id", *[f"{e} as {n}" for n, e in DEGREES.items()])
    return p.select("cap_id", rounded(geodesy.convergence(F.col("lon"), F.col("lat")), 6).alias("convergence"))


FOOT_SQL = inverse_sql("captures", "cx", "cy", "d") + sphere_sql("d", "p") + f""", posed as (select *, yaw - radians({CONVERGENCE_SQL}) as heading, case when altitude > 0 then altitude else 10 end as agl from p),
half as (select *, agl * tan(atan({COLS} * 0.00375::double / (2 * {FOCAL}))) / cos(roll) as w, agl * tan(atan({ROWS} * 0.00375::double / (2 * {FOCAL}))) / cos(pitch) as h from posed),
corners as (select cap_id, cx, cy, heading, corner, case when corner in (1, 2) then w else -w end as u, case when corner < 2 then h else -h end as v from half, (select unnest([0, 1, 2, 3]) as corner))"""


def corner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "captures")
    focal = F.lit(FOCAL)
    turn = F.radians(geodesy.convergence(*geodesy.inverse(F.col("cx"), F.col("cy"))))
    corners = geodesy.footprint_corners(
        F.col("cx"), F.col("cy"), F.col("altitude"), F.lit(0.0), F.col("yaw"), F.col("pitch"), F.col("roll"),
        geodesy.field_of_view(focal, F.lit(COLS)), geodesy.field_of_view(focal, F.lit(ROWS)), turn,
    )
    return c.select("cap_id", "cx", "cy", corners.alias("corners"))


@query(with_views(FOOT_SQL + " select cap_id, corner, round(cx + cos(heading) * u + sin(heading) * v, 3) + 0.0::double as x, round(cy - sin(heading) * u + cos(heading) * v, 3) + 0.0::double as y from corners", "captures"))
def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corner_rows(spark, sf_dir).select("cap_id", F.inline("corners"))
    return rows.select("cap_id", "corner", rounded(F.col("x"), 3).alias("x"), rounded(F.col("y"), 3).alias("y"))


def control_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = geodesy.ground_control_points(F.col("corners"), F.lit(COLS), F.lit(ROWS))
    return corner_rows(spark, sf_dir).select("cap_id", points.alias("points"))


POINTS_SQL = f", points as (select cap_id, case when corner >= 2 then {ROWS}::double else 0 end as row_, case when corner in (1, 2) then {COLS}::double else 0 end as col_, cx + cos(heading) * u + sin(heading) * v as x, cy - sin(heading) * u + cos(heading) * v as y from corners)"


@query(
    with_views(
        FOOT_SQL + POINTS_SQL + ", m as (select cap_id, avg(row_) as mr, avg(col_) as mc, avg(x) as mx, avg(y) as my from points group by cap_id), "
        "s as (select p.cap_id, mr, mc, mx, my, sum((col_ - mc) * (col_ - mc)) as cc, sum((row_ - mr) * (row_ - mr)) as rr, sum((col_ - mc) * (row_ - mr)) as cr, sum((col_ - mc) * (x - mx)) as cx, sum((row_ - mr) * (x - mx)) as rx, "
        "sum((col_ - mc) * (y - my)) as cy, sum((row_ - mr) * (y - my)) as ry from points p join m using (cap_id) group by p.cap_id, mr, mc, mx, my), "
        "q as (select *, (rr * cx - cr * rx) / (cc * rr - cr * cr) as a, (cc * rx - cr * cx) / (cc * rr - cr * cr) as b, (rr * cy - cr * ry) / (cc * rr - cr * cr) as d, (cc * ry - cr * cy) / (cc * rr - cr * cr) as e from s) "
        "select cap_id, round(a, 6) + 0.0::double as a, round(b, 6) + 0.0::double as b, round(mx - a * mc - b * mr, 3) + 0.0::double as c, round(d, 6) + 0.0::double as d, round(e, 6) + 0.0::double as e, round(my - d * mc - e * mr, 3) + 0.0::double as f from q",
        "captures",
    )
)
def georeference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affine transform of each capture's control points."""
    points = control_points(spark, sf_dir).select("cap_id", F.inline("points"))
    fit = mosaic.affine_fit(points, ["cap_id"])
    return fit.select("cap_id", *[rounded(F.col(c), 3 if c in "cf" else 6).alias(c) for c in "abcdef"])


@query(
    "select p_partkey as id, round((p_size + 20.5) * 100 * (1 / (200 + p_size)::double) / (4 + p_size % 5), 6) + 0.0::double as gsd_cm, "
    "round((p_size + 20.5) * 100 * (1 / (200 + p_size)::double) / (4 + p_size % 5) / 100 * 1200, 6) + 0.0::double as width_m, "
    "round(2 * atan(1280 * 0.00375::double / (2 * (4 + p_size % 5))), 6) + 0.0::double as hfov from part"
)
def camera_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    focal, size = F.lit(4) + F.col("p_size") % 5, F.col("p_size").cast("double")
    gsd = geodesy.ground_sample_distance_cm(geodesy.height_above_ground_cm(size + 220.5, F.lit(200.0)), 200 + size, focal)
    return p.select(
        F.col("p_partkey").alias("id"), rounded(gsd, 6).alias("gsd_cm"), rounded(geodesy.footprint_metres(gsd, F.lit(1200)), 6).alias("width_m"),
        rounded(geodesy.field_of_view(focal, F.lit(1280)), 6).alias("hfov"),
    )


# homographies
H_SQL = "[1 + (cap_id % 7) * 0.001::double, 0.002::double * (cap_id % 3), cap_id % 50, -0.001::double * (cap_id % 4), 1 - (cap_id % 5) * 0.001::double, cap_id % 30, 0.000001::double * (cap_id % 9), 0.000002::double * (cap_id % 6), 1]"
H = [
    "1 + (cap_id % 7) * cast(0.001 as double)", "cast(0.002 as double) * (cap_id % 3)", "cast(cap_id % 50 as double)", "cast(-0.001 as double) * (cap_id % 4)", "1 - (cap_id % 5) * cast(0.001 as double)",
    "cast(cap_id % 30 as double)", "cast(0.000001 as double) * (cap_id % 9)", "cast(0.000002 as double) * (cap_id % 6)", "cast(1 as double)",
]


@query(
    with_views(
        f", m as (select cap_id, {H_SQL} as h from captures), q as (select cap_id, u, v, (h[1] * u + h[2] * v + h[3]) / (h[7] * u + h[8] * v + h[9]) as x, (h[4] * u + h[5] * v + h[6]) / (h[7] * u + h[8] * v + h[9]) as y "
        f"from m, (values (0, 0), (0, {ROWS}), ({COLS}, {ROWS}), ({COLS}, 0)) c(u, v)) "
        f"select cap_id, trunc(least(min(x), 0) - 0.5::double)::int as xmin, trunc(least(min(y), 0) - 0.5::double)::int as ymin, trunc(greatest(max(x), {COLS}) + 0.5::double)::int as xmax, trunc(greatest(max(y), {ROWS}) + 0.5::double)::int as ymax, "
        "round(sum(x), 3) as sum_x, round(sum(y), 3) as sum_y from q group by cap_id",
        "captures",
    )
)
def warped_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canvas of two images of one size, the second warped: corners under the homography, with the first one's."""
    c = view(spark, sf_dir, "captures").select("cap_id", F.expr(f"array({', '.join(H)})").alias("h"))
    points = [geometry.transform_point(F.col("h"), F.lit(float(u)), F.lit(float(v))) for u, v in ((0, 0), (0, ROWS), (COLS, ROWS), (COLS, 0))]
    x, y = F.array(*[p[0] for p in points]), F.array(*[p[1] for p in points])
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), 3)
    return c.select(
        "cap_id", (F.least(F.array_min(x), F.lit(0.0)) - 0.5).cast("int").alias("xmin"), (F.least(F.array_min(y), F.lit(0.0)) - 0.5).cast("int").alias("ymin"),
        (F.greatest(F.array_max(x), F.lit(float(COLS))) + 0.5).cast("int").alias("xmax"), (F.greatest(F.array_max(y), F.lit(float(ROWS))) + 0.5).cast("int").alias("ymax"), total(x).alias("sum_x"), total(y).alias("sum_y"),
    )


@query(
    with_views(
        FOOT_SQL + POINTS_SQL + f", m as (select p.*, {H_SQL} as h from points p) select cap_id, round((h[4] * col_ + h[5] * row_ + h[6]) / (h[7] * col_ + h[8] * row_ + h[9]) + 7, 3) + 0.0::double as row_new, "
        "round((h[1] * col_ + h[2] * row_ + h[3]) / (h[7] * col_ + h[8] * row_ + h[9]) - 4, 3) + 0.0::double as col_new, row_ + 7 as row_moved, col_ - 4 as col_moved from m",
        "captures",
    )
)
def moved_control_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control points of an image that was warped and of one that was only moved."""
    c = control_points(spark, sf_dir).withColumn("h", F.expr(f"array({', '.join(H)})"))
    both = F.arrays_zip(geometry.warped(F.col("points"), F.col("h"), F.lit(7), F.lit(-4)).alias("w"), geometry.shifted(F.col("points"), F.lit(7), F.lit(-4)).alias("s"))
    rows = c.select("cap_id", F.explode(both).alias("p"))
    return rows.select("cap_id", rounded(F.col("p.w.row"), 3).alias("row_new"), rounded(F.col("p.w.col"), 3).alias("col_new"), F.col("p.s.row").alias("row_moved"), F.col("p.s.col").alias("col_moved"))


@query(
    "select p_partkey as id, round(least(1, sqrt(600000.0 / ((200 + p_size * 20) * (300 + p_size * 30)))), 6) as scale, round(sqrt((200 + p_size * 20) * (300 + p_size * 30)) * 5 / 100, 6) as blend, "
    "trunc(log2(sqrt((200 + p_size * 20) * (300 + p_size * 30)) * 5 / 100) - 1)::int as bands, round(900.0 / least(1, sqrt(600000.0 / ((200 + p_size * 20) * (300 + p_size * 30)))), 6) as focal, "
    "least(greatest(p_size * 3000 - 5000, 0), 65535)::int as clipped from part"
)
def blending_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopyspark.functions.numeric import clip

    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    h, w = 200 + F.col("p_size") * 20, 300 + F.col("p_size") * 30
    scale = geometry.work_scale(h, w)
    camera = geometry.rescaled_camera(F.struct(F.lit(900.0).alias("focal"), F.lit(0.0).alias("ppx"), F.lit(0.0).alias("ppy")), scale)
    blend = geometry.blend_width(w, h)
    return p.select(
        F.col("p_partkey").alias("id"), F.round(scale, 6).alias("scale"), F.round(blend, 6).alias("blend"), geometry.blend_bands(blend).alias("bands"), F.round(camera["focal"], 6).alias("focal"),
        clip((F.col("p_size") * 3000 - 5000).cast("double"), 0.0, 65535.0).cast("int").alias("clipped"),
    )


@query(with_views(", ends as (select aoi_id, min(d4) as low, max(d4) as high from pixels group by aoi_id) select px, case when high > low then trunc((d4 - low) / (high - low)::double * 255)::smallint else 0::smallint end as scaled from pixels join ends using (aoi_id)", "pixels"))
def band_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mosaic.band_bytes(view(spark, sf_dir, "pixels"), ["aoi_id"], "d4").select("px", "scaled")


# matching
def descriptors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each 40 vectors are an image's; it is matched with the next image, which also has slightly bent copies of every third."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("image", F.expr("vec_id div 40"))
    bent = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("vec_id") % 64, 0.125).otherwise(0.0))
    q = e.select(F.col("image").alias("pair"), F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("des"))
    following = e.select((F.col("image") - 1).alias("pair"), F.col("vec_id").alias("target"), F.col("embedding").cast("array<double>").alias("des"))
    near = e.where("vec_id % 3 = 0").select(F.col("image").alias("pair"), (F.col("vec_id") + 1000000000).alias("target"), bent.alias("des"))
    return q, following.unionByName(near)


MATCH_SQL = """
with q as (select vec_id // 40 as pair, vec_id as query, embedding::double[] as des from embeddings),
t as (
  select vec_id // 40 - 1 as pair, vec_id as target, embedding::double[] as des from embeddings
  union all select vec_id // 40, vec_id + 1000000000, list_transform(embedding::double[], lambda x, i: x + case when i - 1 = vec_id % 64 then 0.125::double else 0 end) from embeddings where vec_id % 3 = 0),
d as (select q.pair, query, target, round(list_distance(q.des, t.des), 6) as dist from q join t on q.pair = t.pair),
r as (select *, row_number() over (partition by pair, query order by dist, target)::int as rank from d),
n as (select * from r where rank <= 2)"""


@query(MATCH_SQL + " select pair, query, target, dist, rank from n")
def nearest_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.two_nearest(*descriptors(spark, sf_dir), ["pair"], 6)


@query(MATCH_SQL + ", g as (select pair, query, max(target) filter (rank = 1) as target, max(dist) filter (rank = 1) as dist, max(dist) filter (rank = 2) as second from n group by pair, query) select * from g where dist < 0.75 * second")
def ratio_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.good_matches(matching.two_nearest(*descriptors(spark, sf_dir), ["pair"], 6), ["pair"])


@query(MATCH_SQL + ", g as (select pair, query, max(dist) filter (rank = 1) as dist, max(dist) filter (rank = 2) as second from n group by pair, query) select pair, count(*)::bigint as n from g where dist < 0.75 * second group by pair having count(*) >= 3")
def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.enough(matching.good_matches(matching.two_nearest(*descriptors(spark, sf_dir), ["pair"], 6), ["pair"]), ["pair"], least=3)


@query(with_views(", i as (select distinct capture // 4 as grp, id as img from images) select a.grp, a.img as a, b.img as b from i a join i b on a.grp = b.grp and a.img < b.img", "images"))
def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = view(spark, sf_dir, "images").selectExpr("capture div 4 as grp", "id as img")
    return matching.all_pairs(i, "grp", "img")


@query("""
with recursive n as (select c_nationkey as grp, c_custkey as node from customer),
e as (select o_custkey as src, o_custkey + 25 * (o_orderkey % 3 + 1) as dst, (o_orderkey % 40) / 10.0::double as confidence from orders),
l as (select e.src as a, e.dst as b from e join n x on x.node = src join n y on y.node = dst where confidence >= 1 and x.grp = y.grp union select e.dst, e.src from e join n x on x.node = src join n y on y.node = dst where confidence >= 1 and x.grp = y.grp),
reach as (select node, node as other from n union select r.node, l.b from reach r join l on r.other = l.a),
c as (select n.grp as grp, n.node, min(other) as component from n join reach r on n.node = r.node group by n.grp, n.node),
s as (select grp, component, count(*) as size from c group by grp, component having count(*) >= 2),
best as (select grp, component from (select *, row_number() over (partition by grp order by size desc, component) as k from s) where k = 1)
select c.grp as "group", c.node from c join best using (grp, component)""")
def biggest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_nationkey as group", "c_custkey as node")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey as src", "o_custkey + 25 * (o_orderkey % 3 + 1) as dst", "(o_orderkey % 40) / cast(10 as double) as confidence")
    ends = o.join(n.selectExpr("node as src", "group as g1"), "src").join(n.selectExpr("node as dst", "group as g2"), "dst").where("g1 = g2")
    return graph.biggest_component(n, ends.select("src", "dst", "confidence"))


@query("select label, (list_sort(list(vec_id)))[count(*)::int // 2 + 1] as focal from embeddings group by label")
def upper_median_focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").agg(text.upper_median("vec_id").cast("long").alias("focal"))


@query(
    with_views(
        ", c as (select aoi_id, (aoi_id * 31 + k * 17) % 100 as cx, (aoi_id * 53 + k * 29) % 100 as cy, k as image from areas, range(4) t(k)), "
        "p as (select aoi_id, px, px % 100 as x, (px // 10) % 100 as y, row_number() over () as row_ from pixels), d as (select p.*, image, row_number() over (partition by row_ order by (x - cx) * (x - cx) + (y - cy) * (y - cy), image) as k from p join c on p.aoi_id = c.aoi_id) "
        "select aoi_id, image::bigint as image, count(*)::bigint as n, sum(px)::bigint as total from d where k = 1 group by aoi_id, image",
        "areas", "pixels",
    )
)
def voronoi_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = view(spark, sf_dir, "areas").withColumn("image", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>"))).selectExpr("aoi_id", "image", "(aoi_id * 31 + image * 17) % 100 as cx", "(aoi_id * 53 + image * 29) % 100 as cy")
    pixels = view(spark, sf_dir, "pixels").selectExpr("aoi_id", "px", "px % 100 as x", "(px div 10) % 100 as y")
    return mosaic.seams(pixels, centres, ["aoi_id"]).groupBy("aoi_id", "image").agg(F.count("*").alias("n"), F.sum("px").alias("total"))


# names, labels and jobs
@query(with_views(" select id, regexp_extract(path, '([^/.]*)\\.', 1)[:-3] as name, regexp_extract(path, '([^/.]*)\\.', 1)[:-3] || '_' || (id % 5 + 1)::varchar || '.tif' as file from images", "images"))
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.image_name(F.col("path"))
    return view(spark, sf_dir, "images").select("id", name.alias("name"), text.band_file(name, F.col("id") % 5 + 1).alias("file"))


@query(with_views(" select distinct capture, 'IMG_' || capture::varchar || '_' || k::varchar || '.tif' as file from images, range(1, 6) t(k)", "images"))
def band_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "images").select("capture").distinct()
    return c.select("capture", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("band")).select("capture", text.band_file(F.concat(F.lit("IMG_"), F.col("capture").cast("string")), F.col("band")).alias("file"))


@query(with_views(" select id, label, try_cast(split_part(label, '_', 2) as int) as aoi_id from chunk_labels where try_cast(split_part(label, '_', 2) as int) is not null", "chunk_labels"))
def chunk_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose label names an area; others are skipped."""
    return view(spark, sf_dir, "chunk_labels").withColumn("aoi_id", text.label_aoi(F.col("label"))).where("aoi_id is not null")


@query(with_views(" select l.id, l.label, a.aoi_id, a.ax, a.ay from chunk_labels l join areas a on try_cast(split_part(l.label, '_', 2) as int) = a.aoi_id", "chunk_labels", "areas"))
def chunks_with_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks joined with their area by id; several chunks of one area give several rows."""
    labels = view(spark, sf_dir, "chunk_labels").withColumn("aoi_id", text.label_aoi(F.col("label"))).where("aoi_id is not null")
    return labels.join(view(spark, sf_dir, "areas"), "aoi_id").select("id", "label", "aoi_id", "ax", "ay")


@query(with_views(", c as (select capture, count(*) as n_bands from images where id % 17 <> 3 group by capture) select capture, n_bands::bigint as n_bands, n_bands = (select n_bands from c order by capture limit 1) as complete from c", "images"))
def complete_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.complete_captures(view(spark, sf_dir, "images").where("id % 17 <> 3"), "capture")


@query(with_views(" select distinct capture from images where capture not in (select capture from images where id % 7 = 0)", "images"))
def pending_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = view(spark, sf_dir, "images")
    return jobs.pending(i.select("capture").distinct(), i.where("id % 7 = 0"), "capture")


@query(with_views(", r as (select path, row_number() over (order by path) as k from images) select path from r where k <= 5", "images"))
def first_five_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.first_files(view(spark, sf_dir, "images"), 5).select("path")


@query("with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as k, count(*) over (partition by o_custkey) as n from orders) select o_custkey, o_orderkey from r where k = n // 2 + 1")
def middle_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.middle(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("""
select o_orderkey as id, case when o_orderkey % 3 = 0 then 0.49::double else 0.5::double end as b1, case when o_orderkey % 3 = 0 then 0.49::double else 0.51::double end as b2,
  case when o_orderkey % 3 = 0 then 0.49::double else (o_orderkey % 100) / 100.0::double end as b3, 0.0::double as b4 from orders""")
def panel_reflectances(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    own = F.array(F.lit(0.5), F.lit(0.51), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 100) / F.lit(100.0)))
    found = text.with_light_sensor(text.panel_albedo(own, F.lit(3)))
    return o.select(F.col("o_orderkey").alias("id"), *[F.get(found, F.lit(k)).alias(f"b{k + 1}") for k in range(4)])


@query(with_views(" select aoi_id, ax, ay, (row_number() over (order by aoi_id) - 1)::int as position, case when contains('AOI_' || aoi_id, '1') then 'field.csv' else 'other.csv' end as file, 'a' || aoi_id || '_b' as serial from areas", "areas"))
def areas_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spatial.by_position(view(spark, sf_dir, "areas"), "aoi_id")
    name = F.concat(F.lit("AOI_"), F.col("aoi_id").cast("string"))
    serial = text.serial_key(F.array(F.concat(F.lit("a"), F.col("aoi_id").cast("string")), F.lit("b")))
    return a.select("aoi_id", "ax", "ay", "position", text.aoi_file(name, "1", "field.csv", "other.csv").alias("file"), serial.alias("serial"))


@query(
    with_views(
        ", g as (select c.capture, min(c.path) as path, list_sort(list(distinct {'w': (id % 5) * 100, 'i': (id % 5) * 0.5::double})) as m from images c group by capture) "
        "select capture as capture_id, regexp_extract(path, '([^/.]*)\\.', 1)[:-3] as image_name, len(m)::int as n_wavelengths, list_sum(list_transform(m, lambda x: x.w))::bigint as wavelengths, list_sum(list_transform(m, lambda x: x.i)) as irradiance from g",
        "images",
    )
)
def capture_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = view(spark, sf_dir, "images").select(
        F.col("capture").alias("capture_id"), "path", F.col("path").alias("band"), F.lit(None).cast("timestamp").alias("timestamp"), *[F.lit(0.0).alias(c) for c in ("latitude", "longitude", "altitude", "yaw", "pitch", "roll")],
        ((F.col("id") % 5) * 100).alias("wavelength"), ((F.col("id") % 5) * F.lit(0.5)).alias("irradiance"),
    )
    t = jobs.capture_table(i)
    add = lambda a, zero: F.aggregate(a, zero, lambda s, v: s + v)
    return t.select("capture_id", "image_name", F.size("irradiance").alias("n_wavelengths"), add(F.map_keys("irradiance"), F.lit(0).cast("long")).alias("wavelengths"), add(F.map_values("irradiance"), F.lit(0.0)).alias("irradiance"))


def as_laid(rows: int = 96, cols: int = 176, off: int = 16) -> F.Column:
    """Whether a mosaic is as large as what its captures were cut from, but for the error of registration at its edges."""
    return ((F.abs(F.col("rows") - rows) <= off) & (F.abs(F.col("cols") - cols) <= off)).alias("as_laid")


# consensus and the fold: what is recovered is known in closed form
@query(
    with_views(
        ", m as (select cap_id % 24 as pair, cap_id, (cap_id * 37 % 1280)::double as u, (cap_id * 71 % 960)::double as v from captures), "
        "t as (select *, (1.01::double * u + 0.02::double * v + 12) / (0.00001::double * u - 0.00002::double * v + 1) as x, (-0.015::double * u + 0.99::double * v - 7) / (0.00001::double * u - 0.00002::double * v + 1) as y from m), "
        "w as (select *, cap_id % 5 = 0 as wrong, (u * 7 + 300) % 1280 as wx, (v * 3 + 90) % 960 as wy from t) "
        "select pair, count(*)::bigint as n, count(*) filter (not wrong or sqrt((wx - x) * (wx - x) + (wy - y) * (wy - y)) <= 5)::bigint as inliers, 1.01::double as h1, 0.02::double as h2, 12.0::double as h3, -0.015::double as h4, 0.99::double as h5, -7.0::double as h6, 0.00001::double as h7, -0.00002::double as h8, 1.0::double as h9 from w group by pair",
        "captures",
    )
)
def estimated_homographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homographies recovered from matches of which a fifth are wrong."""
    c = view(spark, sf_dir, "captures").select((F.col("cap_id") % 24).alias("pair"), "cap_id", F.expr(f"transform(array({', '.join(H)}), x -> x)").alias("any"))
    h = F.array(*[F.lit(v) for v in (1.01, 0.02, 12.0, -0.015, 0.99, -7.0, 1e-5, -2e-5, 1.0)])
    u, v = (F.col("cap_id") * 37 % 1280).cast("double"), (F.col("cap_id") * 71 % 960).cast("double")
    x, y = geometry.transform_point(h, u, v)
    wrong = F.col("cap_id") % 5 == 0
    points = c.select("pair", u.alias("sx"), v.alias("sy"), F.when(wrong, (u * 7 + 300) % 1280).otherwise(x).alias("dx"), F.when(wrong, (v * 3 + 90) % 960).otherwise(y).alias("dy"))
    found = matching.homographies(points, ["pair"])
    return found.select("pair", "n", "inliers", *[rounded(F.col("h")[k], 6 if k in (6, 7) else 4).alias(f"h{k + 1}") for k in range(9)])


@query(with_views(" select aoi_id, 3::bigint as n_captures, 3::bigint as n_used, 5 as bands, true as as_laid, 0.5::double as metres, true as in_place from areas", "areas"))
def stitched_mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaics of synthetic captures that overlap, for every area."""
    from canopyspark.plans.scenes import captures_of, read

    tiles = captures_of(view(spark, sf_dir, "areas").select("aoi_id"))
    m = mosaic.stitch(tiles, read=read)
    place = (F.abs(F.col("transform")[2] - 500000 - F.col("aoi_id") * 100) <= 4) & (F.abs(F.col("transform")[5] - 4470000) <= 4)
    return m.select("aoi_id", F.col("n_captures").cast("long").alias("n_captures"), F.col("n_used").cast("long").alias("n_used"), "bands", as_laid(), rounded(F.col("transform")[0], 1).alias("metres"), place.alias("in_place"))


@query(with_views(" select aoi_id, 3::bigint as n_captures, 3::bigint as n_used, 5 as bands, true as as_laid from areas", "areas"))
def detailed_mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaics of the same captures, registered together and blended."""
    from canopyspark.plans.scenes import captures_of, read

    tiles = captures_of(view(spark, sf_dir, "areas").select("aoi_id"))
    centre = lambda c: F.aggregate("points", F.lit(0.0), lambda s, p: s + p[c]) / F.size("points")
    m = detailed.mosaics(tiles.select("aoi_id", "seq", centre("x").alias("x"), centre("y").alias("y")), read)
    return m.select("aoi_id", F.col("n_captures").cast("long").alias("n_captures"), F.col("n_used").cast("long").alias("n_used"), "bands", as_laid())


@query(with_views(" select aoi_id as capture_id, 5 as bands, 40 as \"rows\", 40 as cols, 64000 as bytes, true as has_thumbnail from areas where aoi_id <> 7", "areas"))
def aligned_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks of single bands moved onto the reference band, with their thumbnails' sizes."""
    from canopyspark.plans.scenes import bands_of

    images = bands_of(view(spark, sf_dir, "areas").select("aoi_id"))
    shifts = spark.range(5).selectExpr("cast(id as int) as band", "array(1D, 0D, cast(id - 2 as double), 0D, 1D, 0D, 0D, 0D, 1D) as h")
    found = alignment.aligned(images, shifts, 5)
    return found.select("capture_id", "bands", "rows", "cols", F.octet_length("image").alias("bytes"), (F.octet_length("thumbnail") > 0).alias("has_thumbnail"))


@query("""
select o_orderkey as id, round(o_totalprice / 1000 * pi() / 0.49::double, 6) + 0.0::double as irradiance, case when o_totalprice <> 0 then round(o_totalprice / 2000 * pi() / (o_totalprice / 1000 * pi() / 0.49::double), 6) + 0.0::double end as reflectance
from orders""")
def panel_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    light = alignment.panel_irradiance(F.col("o_totalprice") / 1000, F.lit(text.PANEL_REFLECTANCE))
    return o.select(F.col("o_orderkey").alias("id"), rounded(light, 6).alias("irradiance"), rounded(alignment.reflectance(F.col("o_totalprice") / 2000, light), 6).alias("reflectance"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_statistics(spark, sf_dir)
