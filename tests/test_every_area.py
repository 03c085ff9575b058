"""Mosaics and aligned stacks are made for every area."""

import pytest

from canopyspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, key, lacking", [("stitched_mosaics", "aoi_id", set()), ("detailed_mosaics", "aoi_id", set()), ("aligned_captures", "capture_id", {7})])
def test_every_area(spark, name, key, lacking):
    areas = {r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    assert {r[key] for r in QUERIES[name](spark, SF).collect()} >= areas - lacking
