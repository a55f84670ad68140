"""Points in the plane: outliers, scaling, quadtree, rectangle and radius search, rank budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.functions.mathx import squared_distance, to_unit_square
from scholarium.operators.prefix import numbered, running_total
from scholarium.operators.quantiles import legacy_percentiles
from scholarium.plans.lineage import cut


def quartile_fences(points: DataFrame, column: str, factor: float = 1.5) -> tuple[float | None, float | None]:
    q1, q3 = legacy_percentiles(points, column, [25, 75])
    return (None, None) if q1 is None else (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))


def mark_outliers(points: DataFrame) -> DataFrame:
    """``outlier`` is true where x or y lies beyond 1.5 interquartile ranges."""
    out = F.lit(False)
    for c in ("x", "y"):
        low, high = quartile_fences(points, c)
        if low is not None:
            out = out | (F.col(c) < low) | (F.col(c) > high)
    return points.withColumn("outlier", F.coalesce(out, F.lit(False)))


def normalise(points: DataFrame) -> DataFrame:
    """x and y of the points that are no outliers brought to [-1, 1]; ``points`` has the outlier mark."""
    kept = points.where(~F.col("outlier"))
    b = kept.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    scaled = [to_unit_square(F.col(c), F.lit(b[k]), F.lit(b[k + 1])).alias(c) for c, k in (("x", 0), ("y", 2))]
    return kept.select(*[c for c in kept.columns if c not in ("x", "y", "outlier")], *scaled)


def with_keys(points: DataFrame, depth: int, low: float = -1.0, size: float = 2.0) -> DataFrame:
    """Integer cell keys kx, ky of the finest grid; the upper bound belongs to the last cell."""
    top = (1 << depth) - 1
    key = lambda c: F.greatest(F.least(F.floor((F.col(c) - low) * (1 << depth) / size), F.lit(top)), F.lit(0)).cast("long")
    return points.withColumn("kx", key("x")).withColumn("ky", key("y"))


def leaf_capacity(leaf: int = 112, bunch: int = 28) -> int:
    return min(leaf, leaf // bunch * bunch)


def _levels(keyed: DataFrame, depth: int) -> DataFrame:
    """(d, cx, cy, n, rankmin, rankmax) of every occupied cell of every depth from 1 on.

    Points are first added up per finest cell, so crowded places cost one row.
    """
    fine = keyed.groupBy("kx", "ky").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    up = fine.select("kx", "ky", "n", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("d"))
    shift = F.lit(depth) - F.col("d")
    cells = up.select("d", F.expr(f"shiftright(kx, {depth} - d)").alias("cx"), F.expr(f"shiftright(ky, {depth} - d)").alias("cy"), "n", "lo", "hi")
    del shift
    return cells.groupBy("d", "cx", "cy").agg(F.sum("n").alias("n"), F.min("lo").alias("rankmin"), F.max("hi").alias("rankmax"))


def quadtree_nodes(points: DataFrame, depth: int = 14, capacity: int | None = None) -> DataFrame:
    """(node_id, isleaf, rankmin, rankmax, parent_id, depth, index, n): branch nodes, leaves and empty leaves.

    A cell is a node if its parent holds more than ``capacity`` points (or is the root), and a leaf if it
    holds no more itself or has the last depth. Ids follow the path: parent * 4 + child + 1 with the root 0;
    child index is 2 * x bit + y bit. The children that hold no point are there as empty leaves.
    """
    capacity = capacity or leaf_capacity()
    cells = _levels(with_keys(points, depth), depth)
    parents = cells.select((F.col("d") + 1).alias("d"), F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("n").alias("pn")).where((F.col("pn") > capacity) & (F.col("d") <= depth))
    roots = points.sparkSession.createDataFrame([(1, 0, 0, capacity + 1)], "d int, px long, py long, pn long")
    children = parents.select(F.col("d").cast("int").alias("d"), "px", "py").union(roots.select("d", "px", "py")).select(
        "d", "px", "py", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("index")
    )
    children = children.select("d", (F.col("px") * 2 + F.expr("index DIV 2")).alias("cx"), (F.col("py") * 2 + F.col("index") % 2).alias("cy"), "index")
    nodes = children.join(cells, ["d", "cx", "cy"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    isleaf = (F.col("n") <= capacity) | (F.col("d") == depth)
    path = cell_id("d", "cx", "cy", depth)
    made = nodes.select(path.alias("node_id"), isleaf.alias("isleaf"), "rankmin", "rankmax", F.expr(f"({path_sql(depth)} - 1) DIV 4").alias("parent_id"), F.col("d").alias("depth"), "index", "n")
    total = points.agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rankmin"), F.max("rank").alias("rankmax"))
    root = total.select(F.lit(0).cast("long").alias("node_id"), F.lit(False).alias("isleaf"), "rankmin", "rankmax", F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("index"), "n")
    return made.union(root)


def path_sql(depth: int) -> str:
    """SQL of a cell's id from d, cx, cy: cells before its depth plus the bits of x and y taken in turn."""
    bits = " + ".join(f"((shiftright(cx, {b}) & 1) * 2 + (shiftright(cy, {b}) & 1)) * {4**b}" for b in range(depth))
    return f"(CAST((power(4, d) - 1) / 3 AS BIGINT) + {bits})"


def cell_id(d: str, cx: str, cy: str, depth: int):
    return F.expr(path_sql(depth)).cast("long")


def assign_leaves(points: DataFrame, depth: int = 14, capacity: int | None = None) -> DataFrame:
    """Points with the node_id and depth of their leaf."""
    capacity = capacity or leaf_capacity()
    keyed = with_keys(points, depth)
    cells = _levels(keyed, depth).select("d", "cx", "cy", "n")
    fine = cells.where(F.col("d") == depth).select(F.col("cx").alias("kx"), F.col("cy").alias("ky"))
    path = fine.select("kx", "ky", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("d")).select("kx", "ky", "d", F.expr(f"shiftright(kx, {depth} - d)").alias("cx"), F.expr(f"shiftright(ky, {depth} - d)").alias("cy"))
    leaf = path.join(cells, ["d", "cx", "cy"]).where((F.col("n") <= capacity) | (F.col("d") == depth)).groupBy("kx", "ky").agg(F.min("d").alias("d"))
    leaf = leaf.withColumn("cx", F.expr(f"shiftright(kx, {depth} - d)")).withColumn("cy", F.expr(f"shiftright(ky, {depth} - d)"))
    leaf = leaf.select("kx", "ky", cell_id("d", "cx", "cy", depth).alias("leaf_id"), F.col("d").alias("leaf_depth"))
    return keyed.join(leaf, ["kx", "ky"]).drop("kx", "ky")


def node_box(node: DataFrame, low: float = -1.0, size: float = 2.0) -> DataFrame:
    """Adds x1, y1, x2, y2 and the centre of cells given by d, cx, cy."""
    step = F.lit(size) / F.pow(F.lit(2.0), F.col("d"))
    boxed = node.withColumns({"x1": low + F.col("cx") * step, "y1": low + F.col("cy") * step, "x2": low + (F.col("cx") + 1) * step, "y2": low + (F.col("cy") + 1) * step})
    return boxed.withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2})


def node_cells(nodes: DataFrame, first_id: int = 0, y_first: bool = False) -> DataFrame:
    """Adds d, cx, cy and the box of every node, read from its id; the root has the id ``first_id``, a child's index is 2 * x bit + y bit, or with ``y_first`` 2 * y bit + x bit."""
    deepest = 20
    code = "(_id - CAST((power(4, d) - 1) / 3 AS BIGINT))"
    bit = lambda low: " + ".join(f"(shiftright({code}, {2 * b + low}) & 1) * {1 << b}" for b in range(deepest))
    known = nodes.withColumn("_id", F.col("node_id") - first_id).withColumn("d", F.col("depth"))
    return node_box(known.withColumns({"cx": F.expr(bit(0 if y_first else 1)), "cy": F.expr(bit(1 if y_first else 0))})).drop("_id")


def search_nodes(nodes: DataFrame, points: DataFrame, a: tuple[float, float], b: tuple[float, float], first_id: int = 0, y_first: bool = False, match: Column | None = None, ids: DataFrame | None = None, border_only: bool = False) -> DataFrame:
    """Points (with their node_id) in the rectangle of two corners, found through the leaves.

    Leaves outside the rectangle are pruned; where the points are stored by node_id, Spark prunes their
    partitions by the few leaves left. Points of leaves wholly inside are taken without looking at
    their place, those of border leaves are tested. ``match`` (a text query) and ``ids`` (doc_id) hold for
    all points, or with ``border_only`` only for those of border leaves.
    """
    (x1, x2), (y1, y2) = sorted((a[0], b[0])), sorted((a[1], b[1]))
    cells = node_cells(nodes.where("isleaf"), first_id, y_first)
    touched = cells.where((F.col("x2") >= x1) & (F.col("x1") <= x2) & (F.col("y2") >= y1) & (F.col("y1") <= y2))
    whole = (F.col("x1") >= x1) & (F.col("x2") <= x2) & (F.col("y1") >= y1) & (F.col("y2") <= y2)
    found = points.join(touched.select("node_id", whole.alias("_whole")), "node_id")
    found = found.where(F.col("_whole") | F.col("x").between(x1, x2) & F.col("y").between(y1, y2))
    free = F.col("_whole") if border_only else F.lit(False)
    if match is not None:
        found = found.where(free | match)
    if ids is not None:
        found = found.join(ids.select("doc_id", F.lit(True).alias("_asked")).distinct(), "doc_id", "left").where(free | F.col("_asked")).drop("_asked")
    return found.drop("_whole")


def find_leaf(nodes: DataFrame, places: DataFrame, depth: int, first_id: int = 0, y_first: bool = False) -> DataFrame:
    """``places`` (x, y) with the node_id of the leaf they lie in; each place looks up one cell of each depth."""
    keyed = with_keys(places, depth).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    one, two = ("ky", "kx") if y_first else ("kx", "ky")
    cells = keyed.withColumns({"cx": F.expr(f"shiftright({one}, {depth} - d)"), "cy": F.expr(f"shiftright({two}, {depth} - d)")})
    cells = cells.withColumn("node_id", cell_id("d", "cx", "cy", depth) + first_id)
    return cells.join(nodes.where("isleaf").select("node_id"), "node_id", "left_semi").drop("kx", "ky", "d", "cx", "cy")


def contains(box: tuple[float, float, float, float], x: Column, y: Column) -> Column:
    """Whether a place lies in the closed box x1, y1, x2, y2."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def node_page(points: DataFrame, node_id: int, size: int, page: int = 0, box: tuple[float, float, float, float] | None = None, match: Column | None = None) -> DataFrame:
    """One page of a node's points by falling rank, then id; with a box or a text query those that fit."""
    own = points.where(F.col("node_id") == node_id)
    if box is not None:
        own = own.where(contains(box, F.col("x"), F.col("y")))
    if match is not None:
        own = own.where(match)
    return own.orderBy(F.desc("rank"), "doc_id").offset(page * size).limit(size)


NODE_COLUMNS = ("node_id", "isleaf", "rankmax", "rankmin", "parent_id", "depth", "index")


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Replaces the stored tree; ids ascend by depth, so files in order of the id are in breadth-first order."""
    nodes.select(*NODE_COLUMNS).repartitionByRange("node_id").sortWithinPartitions("node_id").write.mode("overwrite").parquet(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def in_rectangle(points: DataFrame, a: tuple[float, float], b: tuple[float, float], half_open: bool = False, without: DataFrame | None = None) -> DataFrame:
    """Points inside the rectangle of two corners; half_open leaves out the lower bounds."""
    (x1, x2), (y1, y2) = sorted((a[0], b[0])), sorted((a[1], b[1]))
    x, y = F.col("x"), F.col("y")
    lower = (x > x1) & (y > y1) if half_open else (x >= x1) & (y >= y1)
    found = points.where(lower & (x <= x2) & (y <= y2))
    return found if without is None else found.join(without.select("doc_id").distinct(), "doc_id", "left_anti")


def in_radius(points: DataFrame, x: float, y: float, radius: float, least_rank: float = 0.0) -> DataFrame:
    """Points within the radius with at least the rank, and their squared distance; a bounding box comes first."""
    box = F.col("x").between(x - radius, x + radius) & F.col("y").between(y - radius, y + radius)
    d2 = squared_distance(F.col("x"), F.col("y"), F.lit(x), F.lit(y))
    return points.where(box & (F.col("rank") >= least_rank)).withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def rank_budget(points: DataFrame, budget: float) -> DataFrame:
    """Documents by falling rank until their ranks add up to the budget; the one that crosses it is in, ties go by id.

    Ranks are no less than zero. The budget is followed over distinct ranks, so a rank that many
    documents share is one row; only of the rank at which it is crossed are documents counted one by one.
    """
    ranked = points.where(F.col("rank").isNotNull() & ~F.isnan("rank"))
    if budget <= 0:
        return ranked.limit(0)
    values = ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    spent = running_total(cut(values), "rank", F.col("rank") * F.col("n"), "before")
    crossed = spent.where((F.col("before") < budget) & (F.col("before") + F.col("rank") * F.col("n") >= budget)).orderBy("before").limit(1).collect()
    if not crossed:
        return ranked
    rank, before = crossed[0]["rank"], crossed[0]["before"]
    some = numbered(ranked.where(F.col("rank") == rank), "doc_id", "_n").where(F.lit(before) + F.col("_n") * rank < budget).drop("_n")
    return ranked.where(F.col("rank") > rank).unionByName(some)


def inflate(box: tuple[float, float, float, float], by: float) -> tuple[float, float, float, float]:
    x1, y1, x2, y2 = box
    return x1 - by, y1 - by, x2 + by, y2 + by


def scale(box: tuple[float, float, float, float], factor: float) -> tuple[float, float, float, float]:
    x1, y1, x2, y2 = box
    mx, my, hx, hy = (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) / 2 * factor, (y2 - y1) / 2 * factor
    return mx - hx, my - hy, mx + hx, my + hy
