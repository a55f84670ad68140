"""Projection to the plane: Fastmap, force refinement, local affine maps of all rows from control points.

Control points number about the square root of the rows and live on the driver as numpy arrays; all
rows are mapped on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.operators.cluster import bisecting_kmeans, medoids
from scholarium.operators.spatial import mark_outliers, normalise
from scholarium.operators.termmatrix import term_matrix, to_dense
from scholarium.plans.lineage import cut

#: Bound of the control points: the driver holds their distances.
MOST_CONTROL_POINTS = 4000


def pairwise(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)
    return np.sqrt(np.abs(sq[:, None] + sq[None, :] - 2 * x @ x.T))


def normalise_axes(points: np.ndarray) -> np.ndarray:
    """Each axis to [0, 1]; a constant axis to 0."""
    low, span = points.min(axis=0), np.ptp(points, axis=0)
    return np.where(span > 0, (points - low) / np.where(span > 0, span, 1), 0.0)


def normalise_keeping_aspect(points: np.ndarray) -> np.ndarray:
    """The longer axis to [0, 1], the other by the same factor."""
    low, span = points.min(axis=0), np.ptp(points, axis=0).max()
    return (points - low) / span if span > 0 else np.zeros_like(points)


def fastmap(distances: np.ndarray) -> np.ndarray:
    """Two coordinates from farthest pivot pairs, scaled to [0, 1]; up to three points get fixed places."""
    n = len(distances)
    if n == 0:
        return np.zeros((0, 2))
    if n == 1:
        return np.zeros((1, 2))
    if n == 2:
        return np.array([[0.0, 0.0], [float(distances[0, 1] > 0), 0.0]])
    d = distances.astype(float).copy()
    out = np.zeros((n, 2))
    for axis in range(2):
        a, b = divmod(int(np.argmax(np.triu(d, 1))), n)
        gap = d[a, b]
        if gap > 0:
            x = (d[a] ** 2 + gap**2 - d[b] ** 2) / (2 * gap)
            out[:, axis] = x
            d = np.sqrt(np.abs(d**2 - (x[:, None] - x[None, :]) ** 2))
    return normalise_axes(out)


def force_step(points: np.ndarray, distances: np.ndarray, fraction: float = 8.0) -> np.ndarray:
    """One pass that moves points along the lines to each point in turn by the difference of the distances."""
    out = points.copy()
    off = distances[~np.eye(len(distances), dtype=bool)]
    low, high = (off.min(), off.max()) if len(off) else (0.0, 0.0)
    span = high - low if high > low else 1.0
    wanted = (distances - low) / span
    for i in range(len(out)):
        line = out - out[i]
        r = np.maximum(np.hypot(line[:, 0], line[:, 1]), 1e-7)
        delta = wanted[i] - r
        delta = delta * np.abs(delta) / fraction
        delta[i] = 0
        out += line * (delta / r)[:, None]
    return out


def idmap(features: np.ndarray, iterations: int = 50, fraction: float = 8.0) -> np.ndarray:
    """Fastmap, then force steps; scaled to [0, 1]."""
    d = pairwise(features)
    points = fastmap(d)
    for _ in range(iterations if len(points) > 2 else 0):
        points = force_step(points, d, fraction)
    return normalise_axes(points) if len(points) else points


def nearest_neighbour_projection(distances: np.ndarray) -> np.ndarray:
    """Place points one by one where circles around their two nearest placed neighbours meet."""
    n = len(distances)
    out = np.zeros((n, 2))
    if n > 1:
        out[1] = (distances[0, 1], 0.0)
    for k in range(2, n):
        a, b = np.argsort(distances[k, :k], kind="stable")[:2]
        r, s = distances[k, a], distances[k, b]
        line = out[b] - out[a]
        gap = np.hypot(*line)
        if gap == 0:
            out[k] = out[a] + (r, 0.0)
            continue
        along = min(max((r * r - s * s + gap * gap) / (2 * gap), -r), r)
        up = math.sqrt(max(0.0, r * r - along * along))
        base, normal = out[a] + line / gap * along, np.array([-line[1], line[0]]) / gap
        options = [base + normal * up, base - normal * up]
        error = [np.abs(np.hypot(*(out[:k] - o).T) - distances[k, :k]).sum() for o in options]
        out[k] = options[int(np.argmin(error))]
    return out


def affine_maps(x: np.ndarray, control: np.ndarray, placed: np.ndarray, neighbours: int) -> np.ndarray:
    """Places of a batch of rows, each by an affine map of its nearest control points; a row on a control point gets that point's place."""
    n, dims = control.shape
    d2 = np.maximum((x * x).sum(axis=1)[:, None] + (control * control).sum(axis=1)[None, :] - 2 * x @ control.T, 0.0)
    nearest = d2.argmin(axis=1)
    exact = ((x - control[nearest]) ** 2).sum(axis=1)
    w = 1 / np.maximum(d2, 1e-4)
    if neighbours < n:
        order = np.argsort(d2, axis=1, kind="stable")
        np.put_along_axis(w, order[:, neighbours:], 0.0, axis=1)
    total = w.sum(axis=1, keepdims=True)
    p, q = w @ control / total, w @ placed / total
    shift, base = control.mean(axis=0), placed.mean(axis=0)  # sums about the middle lose fewer digits
    c, y = control - shift, placed - base
    products = (c[:, :, None] * y[:, None, :]).reshape(n, dims * 2)
    cross = (w @ products).reshape(-1, dims, 2) - total[:, :, None] * (p - shift)[:, :, None] * (q - base)[:, None, :]
    u, _, vt = np.linalg.svd(cross, full_matrices=False)
    out = np.einsum("bd,bdk,bkl->bl", x - p, u, vt) + q
    return np.where((exact < 1e-4)[:, None], placed[nearest], out)


def control_points(rows: DataFrame, k: int, choice: str = "KMEANS") -> DataFrame:
    """(id, features) of k control points: medoids, random rows (by a hash of the id), or the rows of most leverage.

    KMEANS is topped up with random rows where clusters are fewer than k; REPRESENTATIVE takes no fewer
    rows than there are dimensions. Fewer rows than that are all taken.
    """
    random_order = (F.xxhash64("id"), F.col("id"))
    if choice == "RANDOM":
        return rows.orderBy(*random_order).limit(k)
    if choice == "REPRESENTATIVE":
        gram = rows.select("features")

        def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                x = np.stack(b["features"].to_numpy()).astype(float) if len(b) else None
                if x is not None:
                    total = x.T @ x if total is None else total + x.T @ x
            if total is not None:
                yield pd.DataFrame({"i": range(len(total)), "row": list(total)})

        parts = gram.mapInPandas(squares, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # dims squared cells
        dims = max(r["i"] for r in parts) + 1
        g = np.zeros((dims, dims))
        for r in parts:
            g[r["i"], r["j"]] = r["v"]
        inverse = np.linalg.pinv(g)

        @F.pandas_udf("double")
        def leverage(f: pd.Series) -> pd.Series:
            x = np.stack(f.to_numpy()).astype(float)
            return pd.Series(((x @ inverse) * x).sum(axis=1))

        return rows.withColumn("l", leverage("features")).orderBy(F.desc("l"), "id").limit(max(k, dims)).drop("l")
    clustered, centroids = bisecting_kmeans(rows, k)
    chosen = cut(medoids(clustered, centroids).select("id", F.lit(0).alias("_o")))  # k rows at most
    ranked = clustered.join(F.broadcast(chosen), "id", "left")
    return ranked.orderBy(F.coalesce("_o", F.lit(1)), *random_order).limit(k).select("id", "features")


def lamp(rows: DataFrame, k: int | None = None, choice: str = "RANDOM", iterations: int = 50, percentage: float = 1.0, place: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(id, x, y): control points are placed by ``place`` (idmap if none is given), every row by an affine map of its neighbours among them.

    ``rows`` is (id, features array<double>). The control points (the root of the number of rows unless k
    is given) go to the driver and to every task. More than MOST_CONTROL_POINTS are refused where k
    states them; the root of the number of rows is taken up to that bound, which holds for 16 million rows.
    """
    if k is not None and k > MOST_CONTROL_POINTS:
        raise ValueError(f"more than {MOST_CONTROL_POINTS} control points")
    n = rows.count()
    k = k or min(max(1, math.isqrt(n)), MOST_CONTROL_POINTS)
    sample = control_points(rows, k, choice).orderBy("id").collect()
    schema = f"id {dict(rows.dtypes)['id']}, x double, y double"
    if not sample:
        return rows.sparkSession.createDataFrame([], schema)
    control = np.array([r["features"] for r in sample], dtype=float)
    placed = place(control) if place else idmap(control, iterations)
    use = max(int(len(control) * percentage), 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                some = b.iloc[lo : lo + 500]
                xy = affine_maps(np.stack(some["features"].to_numpy()).astype(float), control, placed, use)
                yield pd.DataFrame({"id": some["id"], "x": xy[:, 0], "y": xy[:, 1]})

    return rows.select("id", "features").mapInPandas(run, schema)


def project_documents(documents: DataFrame, terms: int = 300, number: int = 2, choice: str = "RANDOM") -> DataFrame:
    """(doc_id, x, y) in [-1, 1] of the documents that use one of the ``terms`` most widely used words: term matrix, control points, affine maps, outliers off, scaling.

    Documents without such a word have no place; outliers have none either.
    """
    matrix = cut(term_matrix(documents, number))
    spread = matrix.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(terms)
    words = sorted(r["word"] for r in spread.collect())  # ``terms`` words
    if not words:
        return documents.select("doc_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    placed = cut(lamp(cut(to_dense(matrix, words)), choice=choice))
    return normalise(mark_outliers(placed.withColumnRenamed("id", "doc_id"))).select("doc_id", "x", "y")
