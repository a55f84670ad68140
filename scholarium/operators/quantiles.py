"""Exact order statistics of any number of rows, without a sort on one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.operators.prefix import value_ranks


def at_positions(df: DataFrame, column: str, wanted) -> list[float | None]:
    """Values at 1-based, possibly fractional positions of the ascending order; ``wanted(n)`` gives them for n values.

    Positions are clamped to 1..n and interpolated. No values: Nones.
    """
    ranks = value_ranks(df, column)
    n = ranks.agg(F.sum("n_equal")).first()[0]
    positions = wanted(n or 0)
    if not n:
        return [None for _ in positions]
    whole = sorted({int(k) for p in positions for k in (math.floor(min(max(p, 1), n)), math.ceil(min(max(p, 1), n)))})
    hit = F.lit(False)
    for k in whole:
        hit = hit | ((F.col("n_below") < k) & (F.col("n_below") + F.col("n_equal") >= k))
    rows = ranks.where(hit).collect()  # at most two rows a position
    value = {k: next(r[column] for r in rows if r["n_below"] < k <= r["n_below"] + r["n_equal"]) for k in whole}
    out = []
    for p in positions:
        p = min(max(p, 1), n)
        low, high = value[math.floor(p)], value[math.ceil(p)]
        out.append(low + (p - math.floor(p)) * (high - low))
    return out


def legacy_percentiles(df: DataFrame, column: str, percents: list[float]) -> list[float | None]:
    """Percentiles by position p (n + 1) / 100, clamped to the ends."""
    return at_positions(df, column, lambda n: [p * (n + 1) / 100 for p in percents])


def median(df: DataFrame, column: str) -> float | None:
    return at_positions(df, column, lambda n: [(n + 1) / 2])[0]
