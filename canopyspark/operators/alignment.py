"""Captures from single bands: alignment by stored matrices, reflectance by the panel, and thumbnails."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyspark.functions.numeric import ratio
from canopyspark.operators.mosaic import resample, to_bytes


def reflectance(radiance: Column, irradiance: Column) -> Column:
    """Of a surface that scatters evenly: pi times radiance over irradiance."""
    return ratio(radiance * F.pi(), irradiance)


def panel_irradiance(radiance: Column, albedo: Column) -> Column:
    """What falls on a panel of known reflectance, from the radiance it shows."""
    return ratio(radiance * F.pi(), albedo)


def png(image: np.ndarray) -> bytes:
    """Bytes (rows, cols, 3) as a PNG file."""
    rows, cols, _ = image.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.concatenate([np.zeros((rows, 1), np.uint8), image.reshape(rows, cols * 3)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def thumbnail(stack: np.ndarray, red: int = 2, green: int = 1, blue: int = 0) -> bytes:
    return png(np.stack([to_bytes(stack[b]) for b in (red, green, blue)], axis=-1))


def aligned(images: DataFrame, matrices: DataFrame, n_bands: int, reference: int = 2, thumbnails: bool = True) -> DataFrame:
    """(capture_id, bands, rows, cols, image, thumbnail) of the captures with all their bands.

    images: (capture_id, band from 0, rows, cols, image binary of little-endian doubles); matrices: (band, h of nine) map a
    band onto the reference one, the few of one camera. Incomplete captures are left out.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = ["capture_id", "bands", "rows", "cols", "image", "thumbnail"]
        if sorted(frame.band) != list(range(n_bands)):
            return pd.DataFrame(columns=names)
        rows = {r.band: r for r in frame.itertuples()}
        height, width = rows[reference].rows, rows[reference].cols
        stack = []
        for b in range(n_bands):
            r = rows[b]
            band = np.frombuffer(r.image, dtype="<f8").reshape(1, r.rows, r.cols)
            h = np.eye(3) if r.h is None else np.array(r.h, dtype=float).reshape(3, 3)
            stack.append(resample(band, h, width, height)[0])
        whole = np.stack(stack)
        small = thumbnail(whole, *(min(b, n_bands - 1) for b in (2, 1, 0))) if thumbnails else None
        return pd.DataFrame([[frame.capture_id.iloc[0], n_bands, height, width, whole.astype("<f8").tobytes(), small]], columns=names)

    kind = images.schema["capture_id"].dataType.simpleString()
    rows = images.select("capture_id", "band", "rows", "cols", "image").join(matrices.select("band", "h"), "band", "left")
    return rows.groupBy("capture_id").applyInPandas(run, f"capture_id {kind}, bands int, rows int, cols int, image binary, thumbnail binary")
