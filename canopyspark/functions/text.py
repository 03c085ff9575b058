"""Names, labels and small array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the reflectance of a calibration panel that does not tell its own.
PANEL_REFLECTANCE = 0.49


def image_name(path: Column) -> Column:
    """The last part of a path up to its first dot, without the two characters that name the band."""
    stem = F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("."), F.lit(1))
    return F.substring(stem, F.lit(1), F.length(stem) - 2)


def band_file(name: Column, band: Column) -> Column:
    return F.concat(name, F.lit("_"), band.cast("string"), F.lit(".tif"))


def chunk_label(aoi_id: Column, ratio: Column) -> Column:
    return F.format_string("AOI_%d_ratio_%.2f", aoi_id, ratio)


def label_aoi(label: Column) -> Column:
    """The number in a label, NULL if there is none."""
    return F.get(F.split(label, "_"), F.lit(1)).try_cast("int")


def serial_key(serials: Column) -> Column:
    return F.array_join(serials, "_")


def panel_albedo(albedo: Column, n_bands: Column) -> Column:
    """The panel's own reflectance, or the default in every band if any is missing."""
    usable = albedo.isNotNull() & ~F.exists(albedo, lambda v: v.isNull())
    return F.when(usable, albedo).otherwise(F.array_repeat(F.lit(PANEL_REFLECTANCE), n_bands))


def with_light_sensor(irradiance: Column) -> Column:
    """Band irradiances with a zero behind them for the sensor's own band."""
    return F.concat(irradiance, F.array(F.lit(0.0)))


def aoi_file(experiment: Column, field: str, own: str, other: str) -> Column:
    """Which file of areas an experiment uses, by a part of its name."""
    return F.when(experiment.contains(field), own).otherwise(other)


def upper_median(x: str) -> Column:
    """Aggregate: the middle of the sorted values, the upper one of two. A group keeps its distinct values and their counts."""
    return F.expr(f"percentile_disc(0.5) within group (order by {x} desc)")


def ratio_grid(first: int = 1, last: int = 10, step: float = 0.05) -> Column:
    """0.05, 0.10 .. 0.50."""
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda k: F.round(k * F.lit(step), 2))
