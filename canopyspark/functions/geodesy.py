"""Transverse Mercator projection by the Krueger series, camera geometry and footprints, as column arithmetic.

WGS84 and UTM zone 16 north by default. Angles of attitude are radians.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopyspark.functions.numeric import let, ratio

# The ellipsoid and the projection.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING = 0.9996, 500000.0
ZONE_16 = -87.0

_n = FLATTENING / (2 - FLATTENING)
_c = 2 * math.sqrt(_n) / (1 + _n)
_radius = SCALE * AXIS / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64 + _n**6 / 256)
# The series to the fourth power of the third flattening.
ALPHA = [
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
]
BETA = [
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    17 * _n**3 / 480 - 37 * _n**4 / 840,
    4397 * _n**4 / 161280,
]
DELTA = [
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45,
    7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45,
    56 * _n**3 / 15 - 136 * _n**4 / 35,
    4279 * _n**4 / 630,
]


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _conformal(lon: Column, lat: Column, meridian: float) -> Column:
    """Struct of xi and eta on the sphere, t the tangent of the conformal latitude, and lam the longitude from the meridian."""

    def sphere(t: Column, lam: Column) -> Column:
        return F.struct(F.atan2(t, F.cos(lam)).alias("xi"), F.atanh(F.sin(lam) / F.sqrt(1 + t * t)).alias("eta"), t.alias("t"), lam.alias("lam"))

    def tangent(s: Column, lam: Column) -> Column:
        return let(sphere, t=F.sinh(F.atanh(s) - _c * F.atanh(_c * s)), lam=lam)

    return let(tangent, s=F.sin(F.radians(lat)), lam=F.radians(lon - meridian))


def forward(lon: Column, lat: Column, meridian: float = ZONE_16) -> tuple[Column, Column]:
    """Easting and northing in metres of degrees."""

    def plane(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        east = eta + _sum([a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(ALPHA)])
        north = xi + _sum([a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(ALPHA)])
        return F.struct((FALSE_EASTING + _radius * east).alias("east"), (_radius * north).alias("north"))

    found = let(plane, p=_conformal(lon, lat, meridian))
    return found["east"], found["north"]


def inverse(east: Column, north: Column, meridian: float = ZONE_16) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of metres."""

    def sphere(xi: Column, eta: Column) -> Column:
        x = xi - _sum([b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(BETA)])
        y = eta - _sum([b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(BETA)])
        return let(geographic, x=x, y=y)

    def geographic(x: Column, y: Column) -> Column:
        lat = let(lambda chi: chi + _sum([d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(DELTA)]), chi=F.asin(F.sin(x) / F.cosh(y)))
        return F.struct((meridian + F.degrees(F.atan2(F.sinh(y), F.cos(x)))).alias("lon"), F.degrees(lat).alias("lat"))

    found = let(sphere, xi=north / _radius, eta=(east - FALSE_EASTING) / _radius)
    return found["lon"], found["lat"]


def convergence(lon: Column, lat: Column, meridian: float = ZONE_16) -> Column:
    """Angle in degrees from true north to grid north, positive east of the meridian in the northern half.

    From the derivative of the forward map: the sphere's part and the series' part add up.
    """

    def angle(s: Column) -> Column:
        xi, eta, t, lam = s["xi"], s["eta"], s["t"], s["lam"]
        p = 1 + _sum([2 * (j + 1) * a * F.cos(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(ALPHA)])
        q = _sum([2 * (j + 1) * a * F.sin(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(ALPHA)])
        return F.degrees(F.atan2(t * F.sin(lam), F.sqrt(1 + t * t) * F.cos(lam)) + F.atan2(q, p))

    return let(angle, s=_conformal(lon, lat, meridian))


def height_above_ground_cm(image_alt: Column, panel_alt: Column) -> Column:
    return (image_alt - panel_alt) * 100


def ground_sample_distance_cm(height_cm: Column, plane_resolution: Column, focal_mm: Column) -> Column:
    """Centimetres on the ground per pixel; plane_resolution in pixels per millimetre."""
    return ratio(height_cm * ratio(F.lit(1.0), plane_resolution), focal_mm)


def footprint_metres(gsd_cm: Column, pixels: Column) -> Column:
    return gsd_cm / 100 * pixels


#: Fixed value: millimetres per pixel on the sensor.
PIXEL_MM = 0.00375
#: Height in metres that stands for one that is not positive.
FALLBACK_HEIGHT = 10.0


def field_of_view(focal_mm: Column, pixels: Column, pixel_mm: float = PIXEL_MM) -> Column:
    return 2 * F.atan(ratio(pixels * pixel_mm, 2 * focal_mm))


def footprint_corners(cx: Column, cy: Column, altitude: Column, ground: Column, yaw: Column, pitch: Column, roll: Column, hfov: Column, vfov: Column, convergence_rad: Column) -> Column:
    """Array of (corner, x, y): top left, top right, bottom right, bottom left on the ground, corner counted from 0.

    The heading is corrected by the convergence and each half side is stretched by its tilt.
    """
    agl = F.when(altitude - ground > 0, altitude - ground).otherwise(FALLBACK_HEIGHT)

    def corners(c: Column, s: Column, w: Column, h: Column) -> Column:
        def corner(k: int, right: int, up: int) -> Column:
            x, y = right * w, up * h
            return F.struct(F.lit(k).alias("corner"), (cx + c * x + s * y).alias("x"), (cy - s * x + c * y).alias("y"))

        return F.array(*[corner(k, right, up) for k, (right, up) in enumerate([(-1, 1), (1, 1), (1, -1), (-1, -1)])])

    def turned(heading: Column, height: Column) -> Column:
        return let(corners, c=F.cos(heading), s=F.sin(heading), w=height * F.tan(hfov / 2) / F.cos(roll), h=height * F.tan(vfov / 2) / F.cos(pitch))

    return let(turned, heading=yaw - convergence_rad, height=agl)


def ground_control_points(corners: Column, width: Column, height: Column) -> Column:
    """The footprint's corners with the pixel corners they belong to: array of (row, col, x, y)."""
    return F.transform(
        corners,
        lambda p: F.struct(
            F.when(p["corner"] >= 2, height.cast("double")).otherwise(0.0).alias("row"),
            F.when(p["corner"].isin(1, 2), width.cast("double")).otherwise(0.0).alias("col"),
            p["x"].alias("x"), p["y"].alias("y"),
        ),
    )
