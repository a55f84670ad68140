"""Scalar mathematics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def interpolate(a: Column, b: Column, t: Column) -> Column:
    return a * (1 - t) + b * t


def map_range(x: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """x from [a, b] to [c, d]; a point interval maps to c."""
    return F.when(a == b, c).otherwise((x - a) / (b - a) * (d - c) + c)


def to_unit_square(v: Column, low: Column, high: Column) -> Column:
    """Min-max to [-1, 1]; a constant axis maps to 0."""
    return F.when(high == low, F.lit(0.0)).otherwise(2 * (v - low) / (high - low) - 1)


def squared_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def epanechnikov(x: Column, k: Column | float = 1.0) -> Column:
    k = F.lit(k) if not isinstance(k, Column) else k
    return F.when(F.abs(x / k) <= 1, 0.75 * (1 - (x / k) * (x / k)) / k).otherwise(0.0)


def gaussian(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def radius_scale(value: Column, low: Column, high: Column, smallest: float, largest: float) -> Column:
    """Linear radius of a rank, rounded."""
    return F.round(map_range(value, low, high, F.lit(smallest), F.lit(largest)))


def colour_bucket(value: Column, low: float, high: float, buckets: int = 7) -> Column:
    return F.width_bucket(value, F.lit(low), F.lit(high), F.lit(buckets))


def hypot(a: Column, b: Column) -> Column:
    """Root of the sum of squares without overflow."""
    return F.hypot(a, b)


def to_screen(v: Column, low: float, high: float, size: float) -> Column:
    """Data to screen, linear."""
    return map_range(v, F.lit(low), F.lit(high), F.lit(0.0), F.lit(size))


def to_data(v: Column, low: float, high: float, size: float) -> Column:
    """Screen to data, linear."""
    return map_range(v, F.lit(0.0), F.lit(size), F.lit(low), F.lit(high))
