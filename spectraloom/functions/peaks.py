"""Expressions on m/z values and peak lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bound of the denominator of a relative difference.
PPM_FLOOR = 1e-6


def delta(qry: Column, ref: Column, unit: str) -> Column:
    """Absolute difference in Da, or in ppm of the reference value."""
    apart = F.abs(qry - ref)
    if unit == "da":
        return apart
    if unit == "ppm":
        return apart * (F.lit(1e6) / F.greatest(ref, F.lit(PPM_FLOOR)))
    raise ValueError(f"unit must be 'ppm' or 'da', not {unit!r}")


def within(qry: Column, ref: Column, tolerance: float, unit: str, inclusive: bool = True) -> Column:
    d = delta(qry, ref, unit)
    return d <= tolerance if inclusive else d < tolerance


def split_mz(peaks: Column) -> Column:
    return F.transform(peaks, lambda p: p["mz"])


def split_intensity(peaks: Column) -> Column:
    return F.transform(peaks, lambda p: p["intensity"])


def combine(mzs: Column, intensities: Column) -> Column:
    """Peak structs of two aligned lists; null if either is null or their lengths differ."""
    return F.when(F.size(mzs) == F.size(intensities), F.zip_with(mzs, intensities, lambda m, i: F.struct(m.alias("mz"), i.alias("intensity"))))


def strip_charge(formula: Column) -> Column:
    """The formula before its first '+', or else before its first '-'."""
    return F.when(F.contains(formula, F.lit("+")), F.substring_index(formula, "+", 1)).otherwise(F.substring_index(formula, "-", 1))
