"""Running totals and ranks over a global order, without a window on one partition."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholarium.plans.lineage import cut


def _splits(values: DataFrame, by: str, pieces: int) -> list[float]:
    cuts = values.approxQuantile(by, [i / pieces for i in range(1, pieces)], 0.5 / pieces) if pieces > 1 else []
    return [-float("inf"), *sorted(set(cuts) - {float("inf"), -float("inf")}), float("inf")]


def _ranged(df: DataFrame, by: str, amount: Column, descending: bool, pieces: int | None) -> tuple[DataFrame, Column, float]:
    """(rows with their _range, the sum of all ranges before a row's range, the sum of all)."""
    pieces = pieces or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    splits = _splits(df.select(by), by, pieces)
    if len(splits) == 2:
        ranged = df.withColumn("_range", F.lit(0))
    else:
        ranged = Bucketizer(splits=splits, inputCol=by, outputCol="_range").transform(df).withColumn("_range", F.col("_range").cast("int"))
    totals = {r[0]: r[1] for r in ranged.groupBy("_range").agg(F.sum(amount)).collect()}  # one row a range
    order = range(len(splits) - 2, -1, -1) if descending else range(len(splits) - 1)
    so_far, before = 0.0, [0.0] * (len(splits) - 1)
    for k in order:
        before[k] = so_far
        so_far += float(totals.get(k) or 0)
    return ranged, F.element_at(F.array(*[F.lit(x) for x in before]), F.col("_range") + 1), so_far


def _inside(by: str, amount: Column, descending: bool, ties: list[str]) -> Column:
    key = F.col(by).desc() if descending else F.col(by).asc()
    window = W.partitionBy("_range").orderBy(key, *[F.col(t).asc() for t in ties])
    return F.coalesce(F.sum(amount).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))


def running_total(df: DataFrame, by: str, amount: Column, out: str, descending: bool = True, ties: list[str] | None = None, pieces: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all rows strictly before this one in the order of ``by``.

    ``by`` is a double without null or NaN (the caller filters); ``ties`` are further ascending
    order keys that make the order total. Rows are cut by value into about ``pieces`` ranges (from
    approximate quantiles); each range is summed on its own and the range totals, one number per
    range, are added up on the driver. An empty input gives an empty result.

    Equal values of ``by`` share a range. Where one value may hold a large part of the rows, aggregate
    to distinct values first (see ``value_ranks``).
    """
    ranged, offsets, _ = _ranged(df, by, amount, descending, pieces)
    return ranged.withColumn(out, offsets + _inside(by, amount, descending, ties or [])).drop("_range")


def value_ranks(df: DataFrame, value: str, pieces: int | None = None) -> DataFrame:
    """One row per distinct non-null value: (value, n_equal, n_above, n_below).

    Counts are exact over all rows. The rows are aggregated to distinct values before anything is
    shuffled by range, so a value that a third of the rows share is one row here. NaN counts as no value.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select((F.col(value) + F.lit(0.0)).alias(value))
    counts = cut(clean.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("n_equal")))
    ranged, offsets, total = _ranged(counts, value, F.col("n_equal"), True, pieces)
    above = ranged.withColumn("n_above", offsets + _inside(value, F.col("n_equal"), True, [])).drop("_range")
    return above.withColumn("n_below", F.lit(total) - F.col("n_above") - F.col("n_equal"))


def numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """Add ``out``: the place of each row, from 0, in ascending order of ``by`` (any type; ties in no order).

    Rows are range partitioned by the whole key and sorted there; one count a partition reaches the driver.
    """
    ordered = cut(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_m", F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in ordered.groupBy(F.shiftright("_m", 33)).agg(F.count(F.lit(1))).collect()}
    before, so_far = [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(so_far)
        so_far += counts.get(k, 0)
    offsets = F.element_at(F.array(*[F.lit(x).cast("long") for x in before or [0]]), F.shiftright("_m", 33).cast("int") + 1)
    return ordered.withColumn(out, offsets + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")
