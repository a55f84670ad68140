"""Connected components by label spreading, for links of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.plans.lineage import cut


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """(node, component): component is the smallest node reached; a node without a link has no row.

    Alternates large-star and small-star steps, so the number of rounds grows with the logarithm of
    the longest chain. Each round is cut to the shared checkpoint folder. Null ends and self links are
    ignored. No links: an empty result.
    """
    x, y = F.greatest("_a", "_b"), F.least("_a", "_b")
    edges = links.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a <> _b")
    edges = cut(edges.select(x.alias("_a"), y.alias("_b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        low = both.groupBy("_a").agg(F.min("_b").alias("_low")).select("_a", F.least("_a", "_low").alias("_low"))
        large = both.join(low, "_a").where("_b > _a").select(F.col("_b").alias("_a"), F.col("_low").alias("_b"))
        large = large.where("_a <> _b").distinct()
        low = large.groupBy("_a").agg(F.min("_b").alias("_low"))
        small = large.join(low, "_a")
        edges = cut(
            small.select(F.col("_b").alias("_a"), F.col("_low").alias("_b")).where("_a <> _b")
            .union(low.select("_a", F.col("_low").alias("_b"))).distinct()
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("_b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("_a").alias("node"), F.col("_b").alias("component")).union(roots)
