"""A stated set of query rows against all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def against_all(queries: DataFrame, rows: DataFrame, block_rows: int = 2000) -> DataFrame:
    """Every query row beside every row, the queries in blocks of about ``block_rows`` broadcast rows."""
    n = queries.count()
    blocks = max(1, -(-n // block_rows))
    key = queries.columns[0]
    out = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) if blocks > 1 else queries
        got = rows.crossJoin(F.broadcast(part))  # a block of bounded size
        out = got if out is None else out.union(got)
    return out


def nearest(pairs: DataFrame, query: str, key: str, distance: Column, k: int) -> DataFrame:
    """The k nearest rows of each query; ties by key. Spark keeps k rows a query and task before the shuffle."""
    by = W.partitionBy(query).orderBy("distance", key)
    return pairs.withColumn("distance", distance).withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
