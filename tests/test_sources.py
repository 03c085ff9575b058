"""Files: what is written is read back."""

import io
import json

import numpy as np
import pytest

from canopyspark.operators import statistics
from canopyspark.sources import tables, tiff


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate"])
@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "float32", "float64"])
def test_tiff_round_trip(compression, dtype):
    r = np.random.default_rng(1)
    data = (r.integers(0, 40, (5, 61, 83)) * (1 if dtype == "uint8" else 100)).astype(dtype)
    image = tiff.Image(data, data.shape, 65535.0 if dtype != "uint8" else 255.0, [0.5, 0.0, 500000.0, 0.0, -0.5, 4470000.0], 32616)
    back = tiff.read(io.BytesIO(tiff.write(image, compression)))
    assert (back.data == data).all() and back.data.dtype == data.dtype
    assert back.transform == image.transform and back.epsg == 32616 and back.nodata == image.nodata
    turned = tiff.Image(data, data.shape, None, [0.5, 0.1, 3.0, -0.1, -0.5, 4.0], 4326)
    back = tiff.read(io.BytesIO(tiff.write(turned, compression)), pixels=False)
    assert back.data is None and back.transform == turned.transform and back.epsg == 4326 and back.nodata is None


def test_lzw_of_long_data():
    r = np.random.default_rng(2)
    for data in (b"", b"a", b"a" * 100_000, bytes(r.integers(0, 256, 70_000, dtype=np.uint8)), bytes(r.integers(0, 3, 70_000, dtype=np.uint8))):
        assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_not_a_tiff():
    with pytest.raises(ValueError):
        tiff.read(io.BytesIO(b"PNG nothing"))


def test_tiff_source(spark, tmp_path):
    tiff.register(spark)
    data = np.arange(5 * 4 * 3).reshape(5, 4, 3).astype("uint16") * 300
    data[0, 0, 0] = 65535
    (tmp_path / "in").mkdir()
    for name in ("IMG_1.tif", "IMG_2.tif"):
        (tmp_path / "in" / name).write_bytes(tiff.write(tiff.Image(data, data.shape, 65535, [1.0, 0.0, 10.0, 0.0, -1.0, 20.0], 32616)))
    images = spark.read.format("field_tiff").load(f"file://{tmp_path}/in")
    assert images.count() == 2
    pixels = tiff.explode_pixels(images, ["path"])
    assert pixels.count() == 24
    first = pixels.orderBy("path", "row", "col").first()
    assert (first.x, first.y, first.d1) == (10.5, 19.5, 65535.0)
    s = statistics.statistics(pixels, ["path"], 65535, ["NIR"]).first()
    assert s.total_pixels == 11
    images.write.format("field_tiff").mode("append").option("dtype", "uint16").save(f"file://{tmp_path}/out")
    assert (tiff.read(io.BytesIO((tmp_path / "out" / "IMG_2.tif").read_bytes())).data == data).all()
    heads = spark.read.format("field_tiff").option("pixels", "false").load(f"file://{tmp_path}/in").first()
    assert heads.image is None and heads.bands == 5


def test_tables(spark, tmp_path):
    (tmp_path / "aoi.csv").write_text("Latitude,Longitude\n40.4,-86.9\n40.5,-87.1\n")
    assert [tuple(r) for r in tables.read_centres(spark, f"{tmp_path}/aoi.csv").collect()] == [(0, 40.4, -86.9), (1, 40.5, -87.1)]
    (tmp_path / "ids.csv").write_text("Point_ID,Latitude,Longitude\n121,40.4,-86.9\n")
    assert tables.read_centres(spark, f"{tmp_path}/ids.csv").first().aoi_id == 121
    ring = [[0, 0], [2, 0], [2, 2], [0, 0]]
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 7}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}, indent=1))
    p = tables.read_polygons(spark, f"{tmp_path}/p.geojson").first()
    assert p.aoi_id == 7 and [(v.x, v.y) for v in p.ring] == [(0, 0), (2, 0), (2, 2)]
    f = {"type": "Feature", "properties": {"capture_id": "c", "altitude": 100.0, "image_name": "IMG_1", "dls-yaw": 0.5}, "geometry": {"type": "Point", "coordinates": [-86.9, 40.4]}}
    (tmp_path / "c.geojson").write_text(json.dumps({"features": [f]}))
    c = tables.read_captures(spark, f"{tmp_path}/c.geojson").first()
    assert (c.latitude, c.longitude, c.yaw, c.pitch) == (40.4, -86.9, 0.5, None)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, 1.0, 2.0), (1, None, 3.0)], "aoi_id int, x double, y double")
    tables.write_features(rows, f"{tmp_path}/f")
    text = next((tmp_path / "f").glob("*.csv")).read_text().split()
    assert text == ["aoi_id,x,y", "1,,3.0", "2,1.0,2.0"]
    tables.write_geojson(rows.where("x is not null"), f"{tmp_path}/g", ["aoi_id"], "x", "y", by="aoi_id")
    line = json.loads(next((tmp_path / "g" / "aoi_id=2").glob("*.txt")).read_text())
    assert line["geometry"] == {"type": "Point", "coordinates": [1.0, 2.0]}
    m = spark.createDataFrame([("s1", 0, [1.0] * 9)], "camera_serial string, band int, h array<double>")
    tables.write_matrices(m, f"{tmp_path}/m")
    assert tables.read_matrices(spark, f"{tmp_path}/m", "s1").count() == 1
    with pytest.raises(ValueError, match="full_field"):
        tables.chunk(spark.createDataFrame([("a",)], "label string"), "full_field")
