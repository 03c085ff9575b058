"""Formulas, masks, projection, geometry and names against values worked out apart from Spark."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from canopyspark.functions import geodesy, geometry, text
from canopyspark.functions import vegetation as V
from canopyspark.functions.numeric import cut_bits, known, signed_ratio


def value(spark, column, **fields):
    return spark.createDataFrame([Row(**fields)]).select(column.alias("v")).first().v


def div(n, d):
    return n / d if d else None


def by_hand(b, g, r, e, n):
    root = lambda n_, u: n_ / math.sqrt(u) if u > 0 else None
    return {
        "NDVI": div(n - r, n + r), "GNDVI": div(n - g, n + g), "SAVI": 1.5 * (n - r) / (n + r + 0.5), "NDRE": div(n - e, n + e), "TVI": 0.5 * (120 * (n - g) - 200 * (r - g)),
        "ExG": 2 * g - r - b, "SR": n / r if r > 0 else None, "PSRI": (r - g) / n if n > 0 else None, "G": g / r if r > 0 else None, "RDVI": root(n - r, n + r),
        "MCARI2": root(1.5 * (2.5 * (n - r) - 1.3 * (n - g)), (2 * n + 1) ** 2 - (6 * n - 5 * math.sqrt(max(n, 0))) - 0.5), "GRVI": div(g - r, g + r),
        "Red": r, "Green": g, "Blue": b, "RedEdge": e, "NIR": n, "OSAVI": 1.16 * (n - r) / (n + r + 0.16),
    }


@pytest.mark.parametrize("bands", [(0.03, 0.09, 0.06, 0.2, 0.5), (0.0, 0.0, 0.0, 0.0, 0.0), (0.2, 0.2, 0.2, 0.2, 0.2), (0.1, 0.0, 0.3, 0.0, 0.0), (0.0, 1.9, 0.0, 1.9, 1.9)])
def test_indices(spark, bands):
    row = spark.createDataFrame([bands], V.BANDS).select(*[V.index(n).alias(n) for n in V.INDICES]).first().asDict()
    for name, expected in by_hand(*bands).items():
        assert row[name] == (pytest.approx(expected, abs=1e-12) if expected is not None else None), name


def test_unknown_index():
    with pytest.raises(ValueError, match="unknown"):
        V.index("nothing")


def test_thresholds_are_inclusive(spark):
    assert value(spark, V.is_vegetation(F.col("v"), F.col("r")), v=0.05, r=0.10)
    assert not value(spark, V.is_vegetation(F.col("v"), F.col("r")), v=0.0499, r=0.10)
    assert value(spark, V.is_vegetation(F.lit(0.5), F.lit(None).cast("double")), x=1) is False


def test_nodata(spark):
    df = spark.createDataFrame([(1, 65535), (1, 2), (None, 2), (None, 65535)], "d1 int, d2 int")
    assert [r.v for r in df.select(V.is_nodata(["d1", "d2"], 65535).alias("v")).collect()] == [True, False, False, True]
    assert not any(r.v for r in df.select(V.is_nodata(["d1", "d2"], None).alias("v")).collect())


def test_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "n double, d double")
    assert [r.v for r in df.select(signed_ratio(F.col("n"), F.col("d")).alias("v")).collect()] == [math.inf, -math.inf, None, 0.5]
    assert value(spark, known(F.lit(float("nan"))), x=1) is None
    assert [value(spark, cut_bits(F.lit(v), F.lit(1.0), F.lit(3.0)), x=1) for v in (1.0, 2.0, 3.0)] == [0, 127, 255]
    assert value(spark, cut_bits(F.lit(1.0), F.lit(1.0), F.lit(1.0)), x=1) == 0


def test_projection(spark):
    east, north = geodesy.forward(F.col("lon"), F.col("lat"))
    p = spark.createDataFrame([(-86.9, 40.4), (-87.0, 0.0), (-87.0, 90.0 - 1e-9)], "lon double, lat double").select(east.alias("e"), north.alias("n")).collect()
    assert (p[0].e, p[0].n) == pytest.approx((508485.956, 4472159.644), abs=1e-3)
    assert (p[1].e, p[1].n) == pytest.approx((500000, 0))
    assert p[2].n / 0.9996 == pytest.approx(10001965.729, abs=1e-3)


def test_projection_round_trip(spark):
    df = spark.range(2000).selectExpr("-89.9 + (id % 59) * 0.1D as lon", "1 + (id % 79) as lat")
    east, north = geodesy.forward(F.col("lon").cast("double"), F.col("lat").cast("double"))
    lon, lat = geodesy.inverse(F.col("e"), F.col("n"))
    worst = df.withColumns({"e": east, "n": north}).select(F.max(F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat")))).alias("v")).first().v
    assert worst < 1e-9


def test_convergence(spark):
    """The textbook approximation is d_lambda sin(phi); east of the meridian grid north lies clockwise of true north."""
    c = [value(spark, geodesy.convergence(F.lit(lon), F.lit(40.0)), x=1) for lon in (-87.0, -86.0, -88.0)]
    assert c[0] == pytest.approx(0, abs=1e-12)
    assert c[1] == pytest.approx(math.sin(math.radians(40)), abs=1e-3)
    assert c[1] == pytest.approx(-c[2])


@settings(max_examples=10, deadline=None)
@given(yaw=st.floats(-3, 3), roll=st.floats(-0.3, 0.3), pitch=st.floats(-0.3, 0.3), altitude=st.floats(-5, 120))
def test_footprint(spark, yaw, roll, pitch, altitude):
    def at(turn):
        c = geodesy.footprint_corners(*[F.lit(float(v)) for v in (5.0, 9.0, altitude, 0.0, turn, pitch, roll, 0.8, 0.6, 0.01)])
        return [(p.x, p.y) for p in value(spark, c, x=1)]

    corners = at(yaw)
    assert sum(p[0] for p in corners) / 4 == pytest.approx(5) and sum(p[1] for p in corners) / 4 == pytest.approx(9)
    assert [v for p in at(yaw + 2 * math.pi) for v in p] == pytest.approx([v for p in corners for v in p])
    height = altitude if altitude > 0 else 10
    assert math.dist(corners[0], corners[1]) == pytest.approx(2 * height * math.tan(0.4) / math.cos(roll))


def test_polygons(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((10, 10), (20, 10), (20, 20), (10, 20))])
    assert value(spark, geometry.ring_area(square), x=1) == 100
    assert [value(spark, c, x=1) for c in geometry.ring_centroid(square)] == [15, 15]
    assert value(spark, geometry.in_ring(F.lit(15.0), F.lit(11.0), square), x=1)
    assert not value(spark, geometry.in_ring(F.lit(9.9), F.lit(15.0), square), x=1)
    assert value(spark, geometry.touches_cell(F.lit(9.6), F.lit(15.0), 0.5, square), x=1)
    assert not value(spark, geometry.touches_cell(F.lit(9.4), F.lit(15.0), 0.5, square), x=1)


def test_homography_point(spark):
    h = F.array(*[F.lit(float(v)) for v in (2, 0, 1, 0, 2, 3, 0, 0, 2)])
    assert [value(spark, c, x=1) for c in geometry.transform_point(h, F.lit(4.0), F.lit(5.0))] == [4.5, 6.5]
    flat = F.array(*[F.lit(0.0)] * 9)
    assert value(spark, geometry.transform_point(flat, F.lit(4.0), F.lit(5.0))[0], x=1) is None


def test_names(spark):
    assert value(spark, text.image_name(F.lit("a/b/IMG_0042_3.tif")), x=1) == "IMG_0042"
    assert value(spark, text.chunk_label(F.lit(5), F.lit(0.05)), x=1) == "AOI_5_ratio_0.05"
    assert [value(spark, text.label_aoi(F.lit(s)), x=1) for s in ("AOI_5_ratio_0.05", "bad", "AOI_x")] == [5, None, None]
    assert value(spark, text.ratio_grid(), x=1) == [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    assert df.agg(text.upper_median("v").alias("m")).first().m == 3 and df.where("v < 4").agg(text.upper_median("v").alias("m")).first().m == 2


def test_published_points_of_the_projection(spark):
    """Meridian arcs of WGS 84 (45 degrees: 4,984,944.378 m) by the scale 0.9996, and the equator three degrees off the meridian."""
    points = spark.createDataFrame([(-87.0, 0.0), (-87.0, 45.0), (-84.0, 0.0), (-90.0, 0.0)], "lon double, lat double")
    east, north = geodesy.forward(F.col("lon"), F.col("lat"))
    found = [(x.e, x.n) for x in points.select(east.alias("e"), north.alias("n")).collect()]
    assert found[0] == pytest.approx((500000, 0), abs=1e-6) and found[1] == pytest.approx((500000, 4984944.378 * 0.9996), abs=2e-3)
    assert found[2] == pytest.approx((833978.557, 0), abs=2e-3) and found[3] == pytest.approx((166021.443, 0), abs=2e-3)
