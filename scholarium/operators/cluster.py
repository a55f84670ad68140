"""Bisecting k-means over rows of (id, features array)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.functions.vectors import euclidean
from scholarium.plans.lineage import cut

ITERATIONS = 15
SPLITS_AT_ONCE = 16  #: splits after which the rows are written with their clusters; between, a cluster is an expression


def _literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def mean_features(rows: DataFrame, features: str = "features") -> np.ndarray | None:
    """Mean vector by one partial aggregation; None without rows."""
    got = rows.select(array_to_vector(features).alias("v")).agg(Summarizer.mean(F.col("v")).alias("m")).first()["m"]
    return None if got is None else got.toArray()


def _pivot(rows: DataFrame, far_from: np.ndarray, size: int, distance, sampled: bool = True) -> np.ndarray | None:
    """The row at three quarters of the sampled distances: every stride-th member by id hash order, or of all if not ``sampled``."""
    sample = 1 + size // 10
    d = distance(F.col("features"), _literal(far_from))
    ranked = rows.select("id", "features", d.alias("d"))
    if sampled and size > 10:
        ranked = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, size // sample))) == 0).select("id", "features", d.alias("d"))
    cut_at = ranked.agg(F.percentile_approx("d", 0.75, 10_000)).first()[0]
    if cut_at is None:
        return None
    row = ranked.where(F.col("d") >= cut_at).orderBy("d", "id").limit(1).collect()
    return np.array(row[0]["features"], dtype=float)


def _farthest(rows: DataFrame, far_from: np.ndarray, distance) -> np.ndarray | None:
    """The member farthest from a place, the smaller id first."""
    d = distance(F.col("features"), _literal(far_from))
    row = rows.select("id", "features", d.alias("d")).where("d IS NOT NULL").orderBy(F.desc("d"), "id").limit(1).collect()
    return np.array(row[0]["features"], dtype=float) if row else None


def _pivots(rows: DataFrame, centre: np.ndarray, size: int, distance) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different pivots to try: from the sample, from all members, and at last a member with the one farthest from it."""
    for sampled in (True, False):
        one = _pivot(rows, centre, size, distance, sampled)
        two = None if one is None else _pivot(rows, one, size, distance, sampled)
        if two is not None and not np.array_equal(one, two):
            yield one, two
    one = _farthest(rows, centre, distance)
    two = None if one is None else _farthest(rows, one, distance)
    if two is not None and not np.array_equal(one, two):
        yield one, two


def _halves(members: DataFrame, one: np.ndarray, two: np.ndarray, distance, iterations: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Centroids after the Lloyd steps; None if the rows do not fall on both sides."""
    n = [0, 0]
    for _ in range(iterations):
        d1, d2 = distance(F.col("features"), _literal(one)), distance(F.col("features"), _literal(two))
        side = F.when(d1 < d2, 0).when(d1 > d2, 1).otherwise(0 if n[0] <= n[1] else 1)
        got = members.select(side.alias("side"), array_to_vector("features").alias("v")).groupBy("side").agg(Summarizer.mean(F.col("v")).alias("m"), F.count(F.lit(1)).alias("n")).collect()
        if len(got) < 2:
            break
        last = (one, two)
        by = {r["side"]: r for r in got}
        one, two, n = by[0]["m"].toArray(), by[1]["m"].toArray(), [by[0]["n"], by[1]["n"]]
        if np.array_equal(last[0], one) and np.array_equal(last[1], two):
            break
    return None if 0 in n else (one, two)


def bisecting_kmeans(rows: DataFrame, k: int, distance: Callable[[Column, Column], Column] = euclidean, iterations: int = ITERATIONS) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, features, cluster), centroids): the largest cluster is split in two until there are k.

    Pivots are taken from a tenth of the members at the 75th percentile of distance, then ``iterations``
    Lloyd steps follow; ties of a row's distance go to the smaller cluster. A step is one scan with two
    literal centroids and one partial aggregation of vector sums; only centroids reach the driver. If the
    sample gives no two different pivots or no split, all members are asked. A cluster that cannot be
    split (of equal rows) is finished and the next largest is taken, so fewer than k are given only if
    no cluster is left to split. k below 2 or no rows: one cluster or none.
    """
    stored = cut(rows.select("id", "features").withColumn("cluster", F.lit(0)))
    centre = mean_features(stored)
    if centre is None:
        return stored, []
    centroids, sizes = [centre], [stored.count()]
    splits: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # since ``stored`` was written
    finished: set[int] = set()
    while len(centroids) < k:
        open_ones = [i for i in range(len(sizes)) if i not in finished and sizes[i] > 1]
        if not open_ones:
            break
        target, new = min(open_ones, key=lambda i: (-sizes[i], i)), len(centroids)
        members = _labelled(stored, splits, distance).where(F.col("cluster") == target)
        for pivots in _pivots(members, centroids[target], sizes[target], distance):
            halves = _halves(members, *pivots, distance, iterations)
            if halves is None:
                continue
            one, two = halves
            right = members.where(distance(F.col("features"), _literal(one)) > distance(F.col("features"), _literal(two))).count()
            if 0 < right < sizes[target]:
                break
        else:
            finished.add(target)
            continue
        splits.append((target, new, one, two))
        centroids[target], sizes[target] = one, sizes[target] - right
        centroids.append(two)
        sizes.append(right)
        if len(splits) == SPLITS_AT_ONCE:
            stored, splits = cut(_labelled(stored, splits, distance)), []
    return _labelled(stored, splits, distance), centroids


def _labelled(stored: DataFrame, splits: list, distance) -> DataFrame:
    """``stored`` with the clusters after the splits, which are expressions on its rows."""
    for target, new, one, two in splits:
        far = distance(F.col("features"), _literal(one)) > distance(F.col("features"), _literal(two))
        stored = stored.withColumn("cluster", F.when(F.col("cluster") == target, F.when(far, new).otherwise(target)).otherwise(F.col("cluster")))
    return stored


def medoids(clustered: DataFrame, centroids: list[np.ndarray], distance: Callable[[Column, Column], Column] = euclidean) -> DataFrame:
    """(cluster, id): the member nearest to each centroid, the smaller id first."""
    d = F.lit(None).cast("double")
    for i, c in enumerate(centroids):
        d = F.when(F.col("cluster") == i, distance(F.col("features"), _literal(c))).otherwise(d)
    return clustered.groupBy("cluster").agg(F.min_by("id", F.struct(d, F.col("id"))).alias("id"))
