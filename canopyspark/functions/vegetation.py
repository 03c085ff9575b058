"""Vegetation indices and masks over the five reflectance bands b1 (blue), b2 (green), b3 (red), b4 (red edge), b5 (near infrared)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopyspark.functions.numeric import ratio

# The scale of digital numbers and the inclusive thresholds of the vegetation mask.
FULL_REFLECTANCE = 32768.0
LEAST_VALUE = 0.05
LEAST_RDVI = 0.10

BANDS = ["b1", "b2", "b3", "b4", "b5"]
Index = Callable[[Column, Column, Column, Column, Column], Column]


def _over_root(n: Column, under: Column) -> Column:
    """n / sqrt(under), NULL where the root is zero or not real."""
    return F.when(under > 0, n / F.sqrt(under))


def _mcari2(b: Column, g: Column, r: Column, e: Column, n: Column) -> Column:
    # the inner root is of near infrared; published forms have red there
    root = F.sqrt(F.greatest(n, F.lit(0.0)))
    under = (2 * n + 1) * (2 * n + 1) - (6 * n - 5 * root) - 0.5
    return _over_root(1.5 * (2.5 * (n - r) - 1.3 * (n - g)), under)


#: Name -> expression, in the order of output columns. Names, order and coefficients.
INDICES: dict[str, Index] = {
    "NDVI": lambda b, g, r, e, n: ratio(n - r, n + r),
    "GNDVI": lambda b, g, r, e, n: ratio(n - g, n + g),
    "SAVI": lambda b, g, r, e, n: ratio(1.5 * (n - r), n + r + 0.5),
    "NDRE": lambda b, g, r, e, n: ratio(n - e, n + e),
    "TVI": lambda b, g, r, e, n: 0.5 * (120 * (n - g) - 200 * (r - g)),
    "ExG": lambda b, g, r, e, n: 2 * g - r - b,
    "SR": lambda b, g, r, e, n: F.when(r > 0, n / r),
    "PSRI": lambda b, g, r, e, n: F.when(n > 0, (r - g) / n),
    "G": lambda b, g, r, e, n: F.when(r > 0, g / r),
    "RDVI": lambda b, g, r, e, n: _over_root(n - r, n + r),
    "MCARI2": _mcari2,
    "GRVI": lambda b, g, r, e, n: ratio(g - r, g + r),
    "Red": lambda b, g, r, e, n: r,
    "Green": lambda b, g, r, e, n: g,
    "Blue": lambda b, g, r, e, n: b,
    "RedEdge": lambda b, g, r, e, n: e,
    "NIR": lambda b, g, r, e, n: n,
    "OSAVI": lambda b, g, r, e, n: ratio(1.16 * (n - r), n + r + 0.16),
}


def index(name: str, *bands: Column) -> Column:
    """The index ``name`` of the given bands (b1..b5 by default); an unknown name is an error when the plan is built."""
    if name not in INDICES:
        raise ValueError(f"unknown vegetation index {name!r}")
    return INDICES[name](*(bands or [F.col(b) for b in BANDS]))


def register(name: str, expression: Index) -> None:
    """Add an index to the registry."""
    if name.lower() in {n.lower() for n in INDICES}:
        raise ValueError(f"index {name!r} exists")
    INDICES[name] = expression


def key(name: str) -> str:
    """The name as it stands in column names."""
    return name.lower()


def reflectance(d: str) -> Column:
    return F.col(d) / F.lit(FULL_REFLECTANCE)


def is_nodata(digital: list[str], nodata: float | None) -> Column:
    """Whether any band holds the no-data value; nothing does where there is no such value."""
    if nodata is None:
        return F.lit(False)
    found = F.lit(False)
    for d in digital:
        found = found | F.coalesce(F.col(d) == F.lit(nodata), F.lit(False))
    return found


def hsv_value() -> Column:
    return F.greatest(F.col("b3"), F.col("b2"), F.col("b1"))


def is_vegetation(value: Column | None = None, rdvi: Column | None = None, least_value: float = LEAST_VALUE, least_rdvi: float = LEAST_RDVI) -> Column:
    """Bright and green enough, both inclusive; a missing measure is not vegetation."""
    value = hsv_value() if value is None else value
    rdvi = index("RDVI") if rdvi is None else rdvi
    return F.coalesce((value >= least_value) & (rdvi >= least_rdvi), F.lit(False))
