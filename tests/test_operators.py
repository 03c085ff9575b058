"""Statistics, joins, matching and mosaics on small cases."""

import math
import random

import numpy as np
import pytest


from canopyspark.operators import alignment, detailed, graph, jobs, matching, mosaic, spatial, statistics
from canopyspark.operators.features import describe, match
from canopyspark.plans import scenes

PIXEL = "aoi_id int, photo_id int, d1 int, d2 int, d3 int, d4 int, d5 int"


@pytest.fixture(scope="module")
def edge_pixels(spark):
    return spark.createDataFrame(
        [(100, 0, 0, 0, 0, 0, 0), (100, 0, 0, 0, 0, 0, 0), (101, 0, 65535, 1, 1, 1, 1), (102, 0, 1000, 3000, 2000, 5000, 16000), (103, 0, 9000, 9000, 9000, 9000, 9000)], PIXEL
    )


def test_edge_groups(edge_pixels):
    s = {(r.aoi_id, r.vi): r for r in statistics.statistics(edge_pixels).collect()}
    assert s[100, "ndvi"].raw_mean is None and s[100, "savi"].raw_mean == 0 and s[100, "mcari2"].raw_mean == 0
    assert s[101, "nir"].total_pixels == 0 and s[101, "nir"].raw_min is None
    assert s[102, "ndvi"].veg_mean == pytest.approx(7 / 9) and s[102, "ndvi"].veg_std == 0
    assert s[103, "ndvi"].raw_mean == 0 and s[103, "ndvi"].veg_mean is None and s[103, "ndvi"].vegetation_pixels == 0


def test_feature_layouts(spark, edge_pixels):
    areas = spark.createDataFrame([(a, 40.0, -87.0) for a in (100, 101, 102, 103, 104)], "aoi_id int, latitude double, longitude double")
    s = statistics.statistics(edge_pixels)
    aoi = {r.aoi_id: r for r in statistics.features(s, areas, "no_soil", "aoi").collect()}
    many = {r.aoi_id: r for r in statistics.features(s, areas, "no_soil", "orthorectified").collect()}
    raw = {r.aoi_id: r for r in statistics.features(s, areas, "raw", "orthorectified").collect()}
    assert len(statistics.features(s, areas, "raw").columns) == 78
    assert 104 not in aoi and many[104].canopy_cover is None and many[104].total_pixels == 0 and many[104].ndvi_mean is None
    assert aoi[101].canopy_cover is None and many[101].canopy_cover == 0
    assert raw[102].canopy_cover == 1 and raw[102].total_pixels == 0
    with pytest.raises(ValueError):
        statistics.features(s, areas, "other")


def test_moments_do_not_depend_on_parts(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 2), r.randint(0, 4), *[r.randint(0, 20000) for _ in range(5)]) for _ in range(500)]
    df = spark.createDataFrame(rows, PIXEL)
    whole = {(x.aoi_id, x.vi): x for x in statistics.statistics(df.repartition(1)).collect()}
    parts = {(x.aoi_id, x.vi, x.variant): x for x in statistics.merged(statistics.mergeable(df.repartition(7), ["aoi_id", "photo_id"]), ["aoi_id"]).collect()}
    for (a, vi), x in whole.items():
        if x.raw_mean is None:
            continue
        p = parts[a, vi, "raw"]
        assert (p.mean, p.std, p.min, p.max) == pytest.approx((x.raw_mean, x.raw_std, x.raw_min, x.raw_max), rel=1e-9, abs=1e-9)
        assert x.vegetation_pixels <= x.total_pixels
        if vi == "ndvi":
            assert -1 <= x.raw_min <= x.raw_max <= 1


def test_empty(spark):
    empty = spark.createDataFrame([], PIXEL)
    assert statistics.statistics(empty).count() == 0
    assert statistics.merged(statistics.mergeable(empty, ["aoi_id"]), ["aoi_id"]).count() == 0


def test_box_join(spark):
    r = random.Random(1)
    points = [(k, r.uniform(0, 500), r.uniform(0, 500)) for k in range(400)] + [(1000, 100.0, 50.0), (1001, 120.0, 60.0)]
    boxes = [(k, (x := r.uniform(0, 450)), (y := r.uniform(0, 450)), x + r.uniform(1, 90), y + r.uniform(1, 90)) for k in range(30)] + [(99, 100.0, 40.0, 130.0, 70.0)]
    p = spark.createDataFrame(points, "id int, cx double, cy double")
    b = spark.createDataFrame(boxes, "box int, xmin double, ymin double, xmax double, ymax double")
    joined = spatial.points_in_boxes(p, b, 40.0)
    expected = {(n, k) for n, x0, y0, x1, y1 in boxes for k, x, y in points if x0 < x < x1 and y0 < y < y1}
    assert {(r.box, r.id) for r in joined.select("box", "id").collect()} == expected and joined.count() == len(expected)
    assert (99, 1000) not in expected and (99, 1001) in expected
    assert "NestedLoop" not in joined._jdf.queryExecution().toString()


def test_two_nearest_and_ratio(spark):
    q = spark.createDataFrame([(1, 1, [0.0, 0.0]), (1, 2, [5.0, 5.0]), (2, 3, [0.0, 0.0])], "pair int, query int, des array<double>")
    t = spark.createDataFrame([(1, 10, [0.0, 1.0]), (1, 11, [0.0, 9.0]), (1, 12, [0.0, 9.0]), (2, 13, [1.0, 0.0])], "pair int, target int, des array<double>")
    near = matching.two_nearest(q, t, ["pair"])
    assert {(r.query, r["rank"]): r.target for r in near.collect()} == {(1, 1): 10, (1, 2): 11, (2, 1): 10, (2, 2): 11, (3, 1): 13}
    assert [(r.query, r.target) for r in matching.good_matches(near, ["pair"]).collect()] == [(1, 10)]


def test_consensus():
    h = np.array([[1.01, 0.02, 12], [-0.015, 0.99, -7], [1e-5, -2e-5, 1]])
    r = np.random.default_rng(0)
    src = r.uniform(0, 1000, (100, 2))
    dst = matching.project(h, src)
    dst[::4] = r.uniform(0, 1000, (25, 2))
    found, inliers = matching.consensus(src, dst)
    assert np.abs(found - h).max() < 1e-6 and inliers.sum() == 75
    assert matching.consensus(src[:3], dst[:3])[0] is None
    assert matching.consensus(np.zeros((20, 2)), np.zeros((20, 2)))[0] is None


def test_features_follow_a_shift():
    ground = mosaic.to_bytes(scenes.ground(5, 120, 160)[3])
    (pa_, da), (pb, db) = describe(ground[:, :110]), describe(ground[:, 30:140])
    left, right = match(da, db, 0.75)
    assert len(left) >= 10
    assert np.median(pa_[left] - pb[right], axis=0) == pytest.approx([30, 0], abs=0.5)
    assert match(da[:0], db, 0.75)[0].size == 0


def test_fold():
    images, points = scenes.frames(2)
    canvas, held, n = mosaic.fold(images, points)
    assert n == 3 and canvas.shape[1:] >= (scenes.SIDE, scenes.SIDE + 2 * scenes.STEP - 2) and len(held) == 12
    a = mosaic.affine(held)
    assert (a[0], a[4]) == pytest.approx((0.5, -0.5), abs=0.02)
    assert mosaic.fold([], [])[2] == 0
    alone = mosaic.fold(images[:1], points[:1])
    assert alone[2] == 1 and (alone[0] == images[0]).all()
    given_up = mosaic.fold(images, points, lambda a, b: None)
    assert given_up[2] == 1 and (given_up[0] == images[-1]).all()


def test_paste_puts_the_reference_on_top():
    ref, other = np.full((1, 4, 4), 7.0), np.full((1, 4, 4), 3.0)
    h = np.array([[1, 0, -2.0], [0, 1, 0], [0, 0, 1]])
    canvas, points = mosaic.paste(ref, other, h, np.array([[0, 0, 1, 1.0]]), np.array([[0, 0, 2, 2.0]]))
    assert canvas[0, 1].tolist()[:2] == [3, 3] and (canvas[0, :4, -4:] == 7).all()
    assert points[:, 1].tolist() == [2, 0]


def test_blend():
    a, b = np.full((32, 32), 10.0), np.full((32, 32), 20.0)
    left = np.zeros((32, 32))
    left[:, :16] = 1
    out = mosaic.pyramid_blend([a, b], [left, 1 - left], 3)
    assert out[16, 1] < 12 and out[16, 30] > 18 and 10 <= out.min() and out.max() <= 20
    assert np.allclose(mosaic.pyramid_blend([a], [np.ones((32, 32))], 3), a)


def test_affine_fit(spark):
    pts = [(1, float(r), float(c), 2 * c + 0.5 * r + 7, -r + 3.0) for r in range(4) for c in range(3)] + [(2, 1.0, 1.0, 0.0, 0.0), (2, 2.0, 2.0, 1.0, 1.0)]
    fit = {r.k: r for r in mosaic.affine_fit(spark.createDataFrame(pts, "k int, row double, col double, x double, y double"), ["k"]).collect()}
    assert [fit[1][c] for c in "abcdef"] == pytest.approx([2, 0.5, 7, 0, -1, 3]) and fit[2].a is None


def test_components(spark):
    nodes = spark.createDataFrame([(1, k) for k in range(8)] + [(2, k) for k in (100, 101)], "group int, node long")
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, 1.0), (3, 4, 5.0), (4, 5, 0.5), (6, 7, 9.0), (100, 101, 0.9)], "src long, dst long, confidence double")
    assert sorted((r.group, r.node) for r in graph.biggest_component(nodes, edges).collect()) == [(1, 0), (1, 1), (1, 2)]


def test_jobs(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)], "capture_id int, band int")
    assert {r.capture_id: r.complete for r in jobs.complete_captures(rows).collect()} == {1: True, 2: False, 3: True}
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert [jobs.read_or_build(spark, f"{tmp_path}/t", build).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    with pytest.raises(ValueError, match="no panel"):
        jobs.single(rows.where("false"), "panel")
    assert jobs.job_log(spark, [(1, 5, 0.5)]).columns == ["id", "num_captures", "process_time"]


def test_seams(spark):
    centres = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0)], "aoi_id int, image int, cx double, cy double")
    pixels = spark.createDataFrame([(1, 1.0, 0.0), (1, 9.0, 0.0), (1, 5.0, 0.0)], "aoi_id int, x double, y double")
    assert [r.image for r in mosaic.seams(pixels, centres, ["aoi_id"]).orderBy("x").collect()] == [0, 0, 1]


def test_band_bytes(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 2.0), (2, 5.0)], "k int, b double")
    assert sorted((r.k, r.scaled) for r in mosaic.band_bytes(df, ["k"], "b").collect()) == [(1, 0), (1, 127), (1, 255), (2, 0)]
    assert math.isclose(float(mosaic.to_bytes(np.array([[0.0, 1.0, 2.0]]))[0, 1]), 127)


def test_detailed():
    images, points = scenes.frames(3)
    centres = np.array([p[:, 2:].mean(axis=0) for p in points])
    noise = np.round(np.random.default_rng(0).uniform(0, 20000, images[0].shape))
    mosaic_, held, members = detailed.compose([*images, noise], np.vstack([centres, [0, 0]]))
    assert members == [0, 1, 2] and held.shape == (3, 4)
    width = scenes.SIDE + 2 * scenes.STEP
    assert abs(mosaic_.shape[2] - width) <= 2 and abs(mosaic_.shape[1] - scenes.SIDE) <= 3
    truth = scenes.ground(3, scenes.SIDE, width)
    r, c = min(truth.shape[1], mosaic_.shape[1]), min(truth.shape[2], mosaic_.shape[2])
    assert np.corrcoef(truth[3, 8 : r - 8, 8 : c - 8].ravel(), mosaic_[3, 8 : r - 8, 8 : c - 8].ravel())[0, 1] > 0.9
    assert detailed.compose([noise, images[0]], centres[:2]) is None and detailed.compose(images[:1], centres[:1]) is None


def test_adjustment_brings_the_chain_together():
    r = np.random.default_rng(1)
    true = {0: np.eye(3), 1: np.array([[1, 0.01, 30], [-0.01, 1, 2], [1e-5, 0, 1]]), 2: np.array([[0.99, 0, 60], [0, 1.01, -3], [0, 1e-5, 1]])}
    pairs = []
    for a, b in ((0, 1), (1, 2), (0, 2)):
        p = r.uniform(0, 100, (30, 2))
        q = matching.project(np.linalg.inv(true[b]) @ true[a], p)
        pairs.append(detailed.Pair(a, b, p, q, np.linalg.inv(true[b]) @ true[a], 2.0))
    off = {k: h + (k > 0) * r.normal(0, 1, (3, 3)) * np.array([[0.01, 0.01, 2], [0.01, 0.01, 2], [0, 0, 0]]) for k, h in true.items()}
    found = detailed.adjusted(off, pairs)
    for k in true:
        assert np.abs(matching.project(found[k], np.array([[50.0, 50.0]])) - matching.project(true[k], np.array([[50.0, 50.0]]))).max() < 0.05


def test_alignment(spark):
    from canopyspark.plans.scenes import bands_of, ground

    images = bands_of(spark.createDataFrame([(1,), (7,)], "aoi_id int"))
    m = spark.createDataFrame([(b, [1.0, 0.0, float(b - 2), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for b in range(5) if b != 2], "band int, h array<double>")
    rows = alignment.aligned(images, m, 5).collect()
    assert [r.capture_id for r in rows] == [1]
    stack = np.frombuffer(rows[0].image, dtype="<f8").reshape(5, 40, 40)
    whole = ground(1, 40, 48)
    for b in range(5):
        assert np.allclose(stack[b, :, 2:38], whole[b, :, 4:40])
    assert bytes(rows[0].thumbnail).startswith(b"\x89PNG")
