"""The same operators over growing input: arriving points added to a stored grid, arriving records upserted."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.operators.density import Box, density_grid, merge_grids
from scholarium.operators.ingest import upsert_documents
from scholarium.plans.lineage import cut


def grow_grid(stored: DataFrame, arrived: DataFrame, gone: DataFrame | None, box: Box, bw: float) -> DataFrame:
    """The grid after points have come and others have gone; kernels add up, so the rest is not read again."""
    grid = merge_grids(stored, density_grid(arrived, box, bw))
    return grid if gone is None else merge_grids(grid, density_grid(gone, box, bw, sign=-1))


BUCKET, VERSION = "_bucket", "_version"


def stored(spark: SparkSession, store: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest rows of each bucket (of the versions below ``before``); None if there are none."""
    try:
        rows = spark.read.parquet(store)
    except AnalysisException:  # nothing written yet
        return None
    if before is not None:
        rows = rows.where(F.col(VERSION) < before)
    if buckets is not None:
        rows = rows.where(F.col(BUCKET).isin(buckets))
    newest = rows.groupBy(BUCKET).agg(F.max(VERSION).alias(VERSION)).collect()  # one row a bucket
    if not newest:
        return None
    chosen = F.lit(False)
    for r in newest:
        chosen = chosen | (F.col(BUCKET) == r[BUCKET]) & (F.col(VERSION) == r[VERSION])
    return rows.where(chosen)  # partition columns only: other versions are not read


def upsert_batch(batch: DataFrame, number: int, store: str, arrival: str, key: str = "doi", id_column: str = "doc_id", buckets: int = 16) -> None:
    """Upsert one batch: only the buckets of its keys are read and written anew, as version ``number``.

    Rows delivered again change nothing: keyed rows meet under their key, rows without a key under their
    id. A batch run twice writes the same version. The version before is kept, so that a batch can be
    run again and readers that have begun can end; older ones are removed.
    """
    spark = batch.sparkSession
    place = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(id_column).cast("string"))), F.lit(buckets)).cast("int")
    batch = cut(batch.withColumn(BUCKET, place))
    touched = [r[0] for r in batch.select(BUCKET).distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    old = stored(spark, store, number, touched)
    rows = batch if old is None else old.drop(VERSION).unionByName(batch)
    rows = rows.where(F.col(key).isNotNull()).unionByName(rows.where(F.col(key).isNull()).groupBy(id_column).agg(*[F.min_by(c, F.struct(arrival)).alias(c) for c in rows.columns if c != id_column]).select(rows.columns))
    first = upsert_documents(rows, arrival, key, id_column)
    came = rows.groupBy(id_column).agg(F.min(arrival).alias(arrival))  # stays with the kept record for later batches
    new = first.join(came, id_column).select(rows.columns).withColumn(VERSION, F.lit(number))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, VERSION).parquet(store)
    _forget(spark, store, touched, number)


def _forget(spark: SparkSession, store: str, buckets: list[int], number: int) -> None:
    """Remove the versions of the buckets older than the one before ``number``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    for b in buckets:
        folders = [f.getPath() for f in fs.listStatus(path(f"{store}/{BUCKET}={b}"))]
        versions = sorted(int(f.getName().split("=")[1]) for f in folders if "=" in f.getName())
        kept = set([v for v in versions if v >= number] + [v for v in versions if v < number][-1:])
        for f in folders:
            if "=" in f.getName() and int(f.getName().split("=")[1]) not in kept:
                fs.delete(f, True)


def upsert_stream(arriving: DataFrame, store: str, arrival: str, checkpoint: str, key: str = "doi", id_column: str = "doc_id", buckets: int = 16):
    """A streaming query that upserts each batch into the versioned buckets of ``store``; ``stored`` reads them."""
    one = lambda batch, number: upsert_batch(batch, number, store, arrival, key, id_column, buckets)
    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
