"""Table scans. A table is one parquet file or a folder of parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "documents", "authors", "document_authors", "citations", "documents_data", "nodes",
    "eval_items", "source_trust", "pack_budgets", "embeddings",
)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan <directory>/<name>.parquet; filters and column pruning reach the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
