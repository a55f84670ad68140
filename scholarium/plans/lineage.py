"""Cutting lineage so that lost executors cost a re-read and not a replay."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder (spark.checkpoint.dir); make one of our own only in local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scholarium-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Write df to the shared folder in buckets of ``key`` and go on from there: joins and aggregations on the key move only the other side."""
    spark = df.sparkSession
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"bucketed_{uuid.uuid4().hex}"
    spread = df.repartition(buckets, key)  # one file a bucket
    spread.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", shared_folder(spark, name)).saveAsTable(name)
    return spark.table(name)
