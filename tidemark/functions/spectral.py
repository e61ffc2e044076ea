"""Band arithmetic (P1-P14): scaling, quality masks, normalised differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gain and offset of surface reflectance, the bits that make a pixel invalid (fill, dilated cloud, cirrus,
#: cloud, shadow) and the scene classes that are valid.
LANDSAT_GAIN, LANDSAT_OFFSET, SENTINEL_SCALE = 2.75e-5, -0.2, 10000.0
QA_INVALID_BITS = (0, 1, 2, 3, 4)
SCENE_CLASSES = (2, 4, 5, 6, 7, 11)


def landsat_reflectance(dn: Column) -> Column:
    return dn * LANDSAT_GAIN + LANDSAT_OFFSET


def sentinel_reflectance(dn: Column) -> Column:
    return dn / SENTINEL_SCALE


def qa_valid(qa: Column, bits: tuple[int, ...] = QA_INVALID_BITS) -> Column:
    """None of the bits is set, and the word isn't 0."""
    return (qa.bitwiseAND(F.lit(sum(1 << b for b in bits))) == 0) & (qa != 0)


def scene_class_valid(scl: Column) -> Column:
    return scl.isin(*SCENE_CLASSES)


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null unless both are positive; NaN counts as null."""
    a, b = (F.when(~F.isnan(x.cast("double")), x.cast("double")) for x in (a, b))
    return F.when((a > 0) & (b > 0), F.try_divide(a - b, a + b))


def evi(nir: Column, red: Column, blue: Column, least: float = 0.1) -> Column:
    """2.5 (nir - red) / (nir + 6 red - 7.5 blue + 1), null where the denominator is near 0 or a band isn't positive."""
    below = nir + 6 * red - 7.5 * blue + 1
    return F.when((nir > 0) & (red > 0) & (blue > 0) & (F.abs(below) > least), F.try_divide(2.5 * (nir - red), below))


#: Name -> builder over a function that gives a band's column.
INDICES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "ndvi": lambda b: normalised_difference(b("nir"), b("red")),
    "ndbi": lambda b: normalised_difference(b("swir16"), b("nir")),
    "mndwi": lambda b: normalised_difference(b("green"), b("swir16")),
    "ndwi": lambda b: normalised_difference(b("green"), b("nir")),
    "evi": lambda b: evi(b("nir"), b("red"), b("blue")),
}


def gated(value: Column, n_valid: Column, least: int = 2) -> Column:
    """Null unless there are `least` observations."""
    return F.when(n_valid >= least, value)
