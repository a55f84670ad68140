"""Vectors held as arrays of numbers: algebra and dissimilarities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = lambda: F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), _ZERO(), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.abs(dot(a, a) + dot(b, b) - 2 * dot(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos, kept in [0, 2]; both zero 0, one zero 2."""
    value = lambda m: F.when((m["x"] == 0) & (m["y"] == 0), 0.0).when((m["x"] == 0) | (m["y"] == 0), 2.0).otherwise(1 - F.greatest(F.least(m["d"] / F.sqrt(m["x"]) / F.sqrt(m["y"]), F.lit(1.0)), F.lit(-1.0)))
    return _once(a, b, value)


def _once(a: Column, b: Column, value: Callable[[Column], Column]) -> Column:
    """``value`` of the struct (d, x, y): product and squared norms, each computed once however often it is named."""
    parts = F.array(F.struct(dot(a, b).alias("d"), dot(a, a).alias("x"), dot(b, b).alias("y")))
    return F.element_at(F.transform(parts, value), 1)


def extended_jaccard(a: Column, b: Column) -> Column:
    """1 / (1 + coefficient); both zero 0, one zero 1; equal vectors give one half."""
    value = lambda m: F.when((m["x"] == 0) & (m["y"] == 0), 0.0).when((m["x"] == 0) | (m["y"] == 0), 1.0).otherwise(1 / (1 + m["d"] / (m["x"] + m["y"] - m["d"])))
    return _once(a, b, value)


def city_block(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), _ZERO(), lambda s, x: s + x)


def infinity_norm(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def zero_share(a: Column) -> Column:
    """Share of the cells that are zero; null for an empty vector."""
    return F.try_divide(F.size(F.filter(a, lambda x: x == 0)), F.size(a))


def is_null_vector(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def nearly_equal(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    """Equal length and no cell that differs by more than the tolerance."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda d: d <= tolerance)


def warp(x: np.ndarray, y: np.ndarray, share: float = 0.25) -> np.ndarray:
    """Dynamic time warping with absolute cost inside a band of ``share`` of the length, for a batch of row pairs."""
    n, m = x.shape[1], y.shape[1]
    if not n or not m:
        return np.full(len(x), 0.0 if n == m else np.inf)
    band = max(int(share * max(n, m)), abs(n - m))
    row = np.full((m + 1, len(x)), np.inf)
    row[0] = 0.0
    for i in range(1, n + 1):
        new = np.full((m + 1, len(x)), np.inf)
        for j in range(max(1, i - band), min(m, i + band) + 1):
            new[j] = np.abs(x[:, i - 1] - y[:, j - 1]) + np.minimum(np.minimum(row[j], new[j - 1]), row[j - 1])
        row = new
    return row[m]


def dynamic_time_warping(a: Column, b: Column) -> Column:
    """Null where a vector is null; vectors of one pair of lengths are done together."""

    @F.pandas_udf("double")
    def run(p: pd.Series, q: pd.Series) -> pd.Series:
        out: list[float | None] = [None] * len(p)
        groups: dict[tuple[int, int], list[int]] = {}
        for k, (x, y) in enumerate(zip(p, q)):
            if x is not None and y is not None:
                groups.setdefault((len(x), len(y)), []).append(k)
        for (n, m), rows in groups.items():
            x = np.array([np.asarray(p.iloc[k], float) for k in rows]).reshape(len(rows), n)
            y = np.array([np.asarray(q.iloc[k], float) for k in rows]).reshape(len(rows), m)
            for k, v in zip(rows, warp(x, y).tolist()):
                out[k] = v
        return pd.Series(out, index=p.index, dtype=object).astype("Float64")

    return run(a, b)


DISSIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {
    "EUCLIDEAN": euclidean, "COSINE_BASED": cosine, "EXTENDED_JACCARD": extended_jaccard, "CITY_BLOCK": city_block, "INFINITY_NORM": infinity_norm, "DYNAMIC_TIME_WARPING": dynamic_time_warping,
}


def dissimilarity(name: str) -> Callable[[Column, Column], Column] | None:
    """By name; unknown or unimplemented kinds give None."""
    return DISSIMILARITIES.get(name.upper())
