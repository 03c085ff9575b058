"""Images and mosaics that no longer fit one window or one canvas."""

import struct

import numpy as np

from canopyspark.operators import detailed, mosaic
from canopyspark.operators.matching import nearest_in_block
from canopyspark.sources import tiff


def test_mosaic_wider_than_any_canvas():
    r = np.random.default_rng(0)
    ground = r.integers(0, 60000, (1, 12, 24_000)).astype(float)
    images = [ground[:, :, k : k + 8_000] for k in range(0, 16_001, 4_000)]
    points = [np.array([[0, 0, k, 0], [0, 8000, k + 8000, 0], [12, 8000, k + 8000, -12]], dtype=float) for k in range(0, 16_001, 4_000)]
    whole, held, n = mosaic.fold(images, points, lambda a, b: np.array([[1, 0, -float(a.shape[2] - 4000 if a.shape[2] > 8000 else 4000)], [0, 1, 0], [0, 0, 1]]))
    assert n == 5 and whole.shape[2] >= 24_000 and len(held) == 15


def test_homographies_that_are_no_view():
    ok = np.array([[1.01, 0.02, 500.0], [-0.01, 0.99, -90000.0], [1e-6, 2e-6, 1]])
    assert mosaic.proper(ok, (96, 96))
    for bad in ([[-1, 0, 0], [0, 1, 0], [0, 0, 1]], [[100, 0, 0], [0, 1, 0], [0, 0, 1]], [[1, 0, 0], [0, 1, 0], [-0.05, 0, 1]], [[1, 0, 0], [1, 0, 0], [0, 0, 1]]):
        assert not mosaic.proper(np.array(bad, dtype=float), (96, 96))
    assert detailed.compose([np.zeros((1, 9, 9))], np.zeros((1, 2))) is None


def test_resample_in_strips(monkeypatch):
    r = np.random.default_rng(1)
    image, h = r.integers(0, 999, (2, 40, 50)), np.array([[1.1, 0.1, 7.3], [-0.1, 0.9, 5.1], [1e-4, 0, 1]])
    whole = mosaic.resample(image, h, 80, 70)
    monkeypatch.setattr(mosaic, "STRIP", 200)
    assert (mosaic.resample(image, h, 80, 70) == whole).all()


def test_two_nearest_in_blocks():
    r = np.random.default_rng(2)
    a, b = r.standard_normal((50, 8)), r.standard_normal((40, 8))
    b[7] = b[3]
    ids = np.arange(40)[::-1] + 100
    found = list(nearest_in_block(a, b, ids, None, rows=16))
    for i in range(50):
        d = np.sqrt(((a[i] - b) ** 2).sum(axis=1))
        expected = sorted(range(40), key=lambda j: (d[j], ids[j]))[:2]
        assert [(j, k) for x, j, _, k in found if x == i] == [(expected[0], 1), (expected[1], 2)]
    assert [x[3] for x in nearest_in_block(a[:2], b[:1], ids[:1], 6)] == [1, 1]


def test_windows_of_strips_and_tiles(tmp_path):
    r = np.random.default_rng(3)
    data = r.integers(0, 60000, (3, 40, 33)).astype("uint16")
    path = tmp_path / "a.tif"
    path.write_bytes(tiff.write(tiff.Image(data, data.shape, transform=[2.0, 0.0, 100.0, 0.0, -2.0, 500.0]), "lzw"))
    with open(path, "rb") as f:
        part = tiff.read(f, True, (5, 21, 3, 30))
    assert (part.data == data[:, 5:21, 3:30]).all() and part.transform == [2.0, 0.0, 106.0, 0.0, -2.0, 490.0] and part.first == (5, 3)
    with open(path, "rb") as f:
        part = tiff.read(f, True, box=[110.0, 470.0, 120.0, 480.0])
    assert (part.data == data[:, 10:15, 5:10]).all()
    with open(path, "rb") as f:
        assert tiff.read(f, True, box=[900.0, 0.0, 901.0, 1.0]) is None


def test_offsets_of_64_bits(tmp_path):
    data = np.arange(12, dtype="<u2").reshape(1, 3, 4)
    tags = [(256, 4, 1, 4), (257, 4, 1, 3), (258, 3, 1, 16), (259, 3, 1, 1), (273, 16, 1, 16), (277, 3, 1, 1), (278, 4, 1, 3), (279, 16, 1, 24)]
    body = struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", *t) for t in tags) + struct.pack("<Q", 0)
    (tmp_path / "b.tif").write_bytes(b"II" + struct.pack("<HHHQ", 43, 8, 0, 40) + data.tobytes() + body)
    with open(tmp_path / "b.tif", "rb") as f:
        assert (tiff.read(f).data == data).all()


def test_bands_are_a_parameter(spark):
    image = np.arange(12, dtype="<f8").reshape(3, 2, 2).tobytes()
    rows = spark.createDataFrame([("a", 3, 2, 2, None, image)], "id string, bands int, rows int, cols int, transform array<double>, image binary")
    found = tiff.explode_pixels(rows, ["id"], [2, 0, 7]).orderBy("row", "col").collect()
    assert [(x.d1, x.d2, x.d3) for x in found] == [(8, 0, None), (9, 1, None), (10, 2, None), (11, 3, None)]
