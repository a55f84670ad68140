"""Kernel density on a grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.functions.mathx import epanechnikov
from scholarium.operators.quantiles import median

Box = tuple[float, float, float, float]


def bandwidth(points: DataFrame) -> float:
    """0.9 min(standard distance, sqrt(1 / ln 2) median distance) n^-0.2; 0 without points or spread."""
    c = points.agg(F.avg("x"), F.avg("y"), F.count(F.lit(1))).first()
    if not c[2]:
        return 0.0
    d2 = (F.col("x") - c[0]) * (F.col("x") - c[0]) + (F.col("y") - c[1]) * (F.col("y") - c[1])
    away = points.select(F.sqrt(d2).alias("d"), d2.alias("d2"))
    spread = math.sqrt(away.agg(F.avg("d2")).first()[0])
    middle = median(away, "d")
    return 0.9 * min(spread, math.sqrt(1 / math.log(2)) * middle) * c[2] ** -0.2


def grid_shape(box: Box, bw: float) -> tuple[int, int, float, float]:
    """(width, height, cell x, cell y)."""
    width = math.ceil((box[3] - box[1]) / bw) + 1
    height = width * 6 // 16
    return width, height, (box[2] - box[0]) / max(1, height - 1), bw


def density_grid(points: DataFrame, box: Box, bw: float, sign: int = 1) -> DataFrame:
    """(i, j, px, py, density) of the grid vertices that any point reaches; sign -1 takes points away again.

    Each point goes straight to the vertices within the bandwidth by arithmetic; one partial
    aggregation adds them up. There is no join and no crowded cell is gathered in one task. A zero
    bandwidth gives an empty grid.
    """
    empty = points.sparkSession.createDataFrame([], "i int, j int, px double, py double, density double")
    if bw <= 0:
        return empty
    width, height, sx, sy = grid_shape(box, bw)
    if height < 1:
        return empty
    x0, y0 = box[0] + sx / 2, box[1] + sy / 2
    lo = lambda c, o, s: F.greatest(F.ceil((F.col(c) - bw - o) / s), F.lit(0))
    hi = lambda c, o, s, n: F.least(F.floor((F.col(c) + bw - o) / s), F.lit(n - 1))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b))
    near = points.select("x", "y", F.explode(span(lo("x", x0, sx), hi("x", x0, sx, height))).alias("i"))
    near = near.select("x", "y", "i", F.explode(span(lo("y", y0, sy), hi("y", y0, sy, width))).alias("j"))
    px, py = F.lit(x0) + F.col("i") * sx, F.lit(y0) + F.col("j") * sy
    d = F.sqrt((F.col("x") - px) * (F.col("x") - px) + (F.col("y") - py) * (F.col("y") - py))
    hit = near.withColumn("d", d).where(F.col("d") < bw)
    summed = hit.groupBy("i", "j").agg((sign * F.sum(epanechnikov(F.col("d") / bw))).alias("density"))
    return summed.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), px.alias("px"), py.alias("py"), "density")


def density_of_neighbours(points: DataFrame, vertices: DataFrame, bw: float) -> DataFrame:
    """``vertices`` (with px, py) and ``density``, the kernel sum of the points closer than the bandwidth; 0 without any.

    Each point is offered to the nine squares of the bandwidth's width around it, so a vertex meets only
    the points of its own square.
    """
    square = lambda c, by=0: (F.floor(F.col(c) / bw) + by).cast("long")
    if bw <= 0:
        return vertices.withColumn("density", F.lit(0.0))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_o")
    offered = points.select("x", "y", around).select("x", "y", (square("x") + F.col("_o.i")).alias("_sx"), (square("y") + F.col("_o.j")).alias("_sy"))
    met = vertices.withColumns({"_sx": square("px"), "_sy": square("py")}).join(offered, ["_sx", "_sy"], "left")
    d = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    kernel = F.when(d < bw, epanechnikov(d / bw)).otherwise(0.0)
    return met.groupBy(*vertices.columns).agg(F.sum(kernel).alias("density"))


def write_grid(grid: DataFrame, path: str) -> None:
    """The grid as text, one line a vertex: i, j, place and density, in order of the vertices."""
    grid.orderBy("i", "j").write.mode("overwrite").csv(path)


def merge_grids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two grids of one shape."""
    return a.union(b).groupBy("i", "j", "px", "py").agg(F.sum("density").alias("density"))
