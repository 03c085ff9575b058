"""Sums of many areas with few pixels each: pixels are shuffled once, and no partial sums are."""

import numpy as np

from canopyspark.operators import statistics


def pixels(spark, n, areas):
    return spark.range(n).selectExpr(f"cast(id % {areas} as int) as aoi_id", "cast(id % 3 as int) as photo_id", *[f"cast((id * {k} + {k}) % 9000 as int) as d{k}" for k in range(1, 6)])


def test_moments_are_shuffled_once(spark):
    parts = statistics.dealt(pixels(spark, 3000, 200), ["aoi_id"])
    assert len(parts) == 1
    found = statistics.merged(statistics.mergeable(parts[0], ["aoi_id", "photo_id"]), ["aoi_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_areas_with_many_pixels_are_summed_where_they_stand(spark):
    p = pixels(spark, 3000, 200).union(pixels(spark, 500, 1))
    parts = statistics.dealt(p, ["aoi_id"])
    assert len(parts) == 2 and sum(x.count() for x in parts) == 3500 and {r.aoi_id for r in parts[0].select("aoi_id").distinct().collect()} == {0}
    found = {(r.aoi_id, r.vi, r.variant): r for x in parts for r in statistics.merged(statistics.mergeable(x, ["aoi_id", "photo_id"]), ["aoi_id"]).collect()}
    for r in statistics.statistics(p).collect():
        m = found[r.aoi_id, r.vi, "raw"]
        assert np.allclose([m["mean"], m["std"], m["min"], m["max"]], [r.raw_mean, r.raw_std, r.raw_min, r.raw_max], atol=1e-9)
