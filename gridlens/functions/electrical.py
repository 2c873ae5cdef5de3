"""Column functions for electrical quantities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = float("inf")


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != INFINITE), c)


def sum_of_squares(h: Column) -> Column:
    return F.aggregate(h, F.lit(0.0), lambda s, x: s + x * x)


def fundamental_current(p: Column, q: Column, v: Column) -> Column:
    """hypot(P, Q) / V; 0 where V is 1 or less."""
    return F.when(v > 1, F.hypot(p, q) / v).otherwise(0.0)


def rms_current(fundamental: Column, energy: Column) -> Column:
    """With the energy of a spectrum, its sum of squares."""
    return F.sqrt(fundamental * fundamental + energy)


def neutral_current(i1: Column, i2: Column, i3: Column) -> Column:
    """Magnitude of the sum of three currents 120 degrees apart."""
    return F.sqrt(F.greatest(F.lit(0.0), i1 * i1 + i2 * i2 + i3 * i3 - i1 * i2 - i2 * i3 - i3 * i1))


def ratio_or_one(numerator: Column, denominator: Column) -> Column:
    """For power factors: 1 where the denominator is 1 or less."""
    return F.when(denominator > 1, numerator / denominator).otherwise(1.0)


def thd_percent(energy: Column, fundamental: Column) -> Column:
    """Distortion of a spectrum of that energy; 0 where the fundamental is 0.01 or less."""
    return F.when(fundamental > 0.01, 100 * F.sqrt(energy) / fundamental).otherwise(0.0)


def live_thd_percent(measured: Column, h: Column, p: Column, q: Column, v: Column) -> Column:
    """A measured value wins; null where the current is 1e-3 or less, or the voltage 1 or less."""
    current = F.hypot(p, q) / v
    return F.coalesce(finite(measured), F.when((v > 1) & (current > 1e-3), 100 * F.sqrt(sum_of_squares(h)) / current))


def plausible_spectrum(h: Column) -> Column:
    """False with a non-finite element, or where all non-zero magnitudes are below 1e-30."""
    sizes = F.filter(F.transform(h, F.abs), lambda x: x > 0)
    return ~F.exists(h, lambda x: F.isnan(x) | (F.abs(x) == INFINITE)) & ~((F.size(sizes) > 0) & (F.array_max(sizes) < 1e-30))


def plausible_percent(c: Column) -> Column:
    """Finite, no denormal, at least 0 and below 1000."""
    return F.coalesce(~F.isnan(c) & (c >= 0) & (c < 1000) & ((c == 0) | (c >= 2.2250738585072014e-308)), F.lit(False))


def imbalance(values: Sequence[Column]) -> Column:
    """(max - min) / |mean|; 0 where |mean| is 1 or less; null unless all are present."""
    mean = sum(values[1:], values[0]) / len(values)
    out = F.when(F.abs(mean) > 1, (F.greatest(*values) - F.least(*values)) / F.abs(mean)).otherwise(0.0)
    return F.when(mean.isNotNull(), out)


def neutral_ratio(neutral: Column, currents: Sequence[Column]) -> Column:
    """Neutral over mean phase current; 0 where the mean is 0.01 or less; null unless all are present."""
    mean = sum(currents[1:], currents[0]) / len(currents)
    return F.when(mean.isNotNull() & neutral.isNotNull(), F.when(mean > 0.01, neutral / mean).otherwise(0.0))
