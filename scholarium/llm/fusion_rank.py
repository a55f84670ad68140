"""One ranking from several scores: first principal component of rank-transformed scores."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.operators.prefix import running_total, value_ranks
from scholarium.plans.lineage import cut


HOT = 200  #: values held by at least one in so many rows, at most HOT of them, are joined by broadcast
SALTS = 1000  #: partitions over which rows without need of the join are spread


def _with_ranks(rows: DataFrame, ranks: DataFrame, score: str, key: str) -> DataFrame:
    """``rows`` with the columns of ``ranks``, one row a value.

    Values of many rows (at most HOT, since each holds its share of all) come by broadcast; rows that
    have one of them, or no score, are spread evenly in the join of the others, so that no task gets them all.
    """
    ranks = cut(ranks)
    columns = [c for c in ranks.columns if c not in (score, "_n")]
    total = ranks.agg(F.sum("_n")).first()[0] or 0
    common = ranks.where(F.col("_n") * HOT >= total).drop("_n")
    rare = ranks.where(F.col("_n") * HOT < total).select(score, F.lit(0).alias("_salt"), F.struct(*columns).alias("_rare"))
    rows = rows.join(F.broadcast(common.select(score, F.struct(*columns).alias("_common"))), score, "left")
    needed = F.col(score).isNotNull() & F.col("_common").isNull()
    rows = rows.withColumn("_salt", F.when(needed, 0).otherwise(1 + F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))).join(rare, [score, "_salt"], "left")
    return rows.select("*", *[F.coalesce(F.col("_common")[c], F.col("_rare")[c]).alias(c) for c in columns]).drop("_salt", "_common", "_rare")


def combined_ranking(df: DataFrame, key: str, scores: dict[str, int]) -> DataFrame:
    """(key, <score>_rank, <score>_above for each score, combined): larger combined is better.

    ``scores`` maps a column to +1 (more is better) or -1. Null and NaN are no score; a key counts
    once (its largest score where repeated rows differ). <score>_rank is the mean rank of the value
    scaled to (0, 1); <score>_above the share of scored keys with a strictly higher value; both are
    null without a score. The correlation matrix of the ranks is one distributed aggregation (pairs
    of present ranks); its first eigenvector, turned so that it agrees with the declared directions,
    gives the loadings. Ranks, not values, enter, so no score dominates by its range; a missing rank
    enters as the middle. A constant score has no correlation and takes loading from its direction
    only. An empty table gives an empty result; equal keys' order is left to the caller.
    """
    names = list(scores)
    clean = {c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double") + F.lit(0.0)) for c in names}
    rows = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(clean[c]).alias(c) for c in names]))
    for c in names:
        ranks = value_ranks(rows, c)
        total = F.col("n_above") + F.col("n_equal") + F.col("n_below")
        ranks = ranks.select(
            F.col(c), F.col("n_equal").alias("_n"), ((F.col("n_below") + (F.col("n_equal") + 1) / 2 - 0.5) / total).alias(f"{c}_rank"), (F.col("n_above") / total).alias(f"{c}_above")
        )
        rows = _with_ranks(rows, ranks, c, key)
    pairs = list(combinations(names, 2))
    spread = lambda x, y: F.stddev_pop(F.when(F.col(f"{y}_rank").isNotNull(), F.col(f"{x}_rank")))
    together = [F.try_divide(F.covar_pop(f"{x}_rank", f"{y}_rank"), spread(x, y) * spread(y, x)) for x, y in pairs]
    got = rows.agg(*[c.alias(f"_{i}") for i, c in enumerate(together)]).first() if pairs else []
    matrix = np.eye(len(names))
    for (x, y), r in zip(pairs, got):
        r = 0.0 if r is None or r != r else r
        matrix[names.index(x), names.index(y)] = matrix[names.index(y), names.index(x)] = r
    declared = np.array([scores[c] for c in names], dtype=float)
    loading = np.linalg.eigh(matrix)[1][:, -1]
    if loading @ declared < 0:
        loading = -loading
    combined = sum(
        ((F.coalesce(F.col(f"{c}_rank"), F.lit(0.5)) - 0.5) * float(w) for c, w in zip(names, loading)), F.lit(0.0)
    )
    return rows.select(key, *[F.col(f"{c}_{s}") for c in names for s in ("rank", "above")], combined.alias("combined"))


def ranking(df: DataFrame, key: str, scores: dict[str, int], digits: int = 6) -> DataFrame:
    """(key, combined, place): the one order of all keys, place 1 first.

    ``combined`` is rounded to ``digits``; keys of equal ``combined`` stand in ascending order of the key. Places are counted by
    ranges of ``combined``, so no task sorts everything.
    """
    ranked = combined_ranking(df, key, scores).select(key, (F.round("combined", digits) + F.lit(0.0)).alias("combined"))
    before = running_total(cut(ranked), "combined", F.lit(1.0), "_before", ties=[key])
    return before.select(key, "combined", (F.col("_before") + 1).cast("long").alias("place"))


SCORES = {"relevance_doc": 1, "relevance_aut": 1, "rank": 1}


def found(documents_data: DataFrame, share: float = 0.1) -> DataFrame:
    """(doc_id): documents in the highest ``share`` of each of the three scores.

    The rule asks for the rank of each score by itself; the order by the principal component is ``ranking`` (query p5_ranking).
    """
    ranked = combined_ranking(documents_data, "doc_id", SCORES)
    for c in SCORES:
        ranked = ranked.where(F.col(f"{c}_above") < share)
    return ranked.select("doc_id")
