"""Text files of sparse and dense matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _first_file(spark: SparkSession, path: str) -> str:
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        raise ValueError(f"{path}: no file")
    return files[0]


def _head(spark: SparkSession, path: str, lines: int) -> list[str]:
    return [r["value"].strip() for r in spark.read.text(_first_file(spark, path)).limit(lines).collect()]


def matrix_kind(spark: SparkSession, path: str) -> str:
    """The two-letter head of a file: S or D (sparse, dense), Y or N (with or without a class column)."""
    first = _head(spark, path, 1)
    kind = first[0] if first else ""
    if kind not in ("SY", "SN", "DY", "DN"):
        raise ValueError(f"{path}: not a matrix file")
    return kind


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(id, features, klass) of a dense or (id, cells map<int,double>, klass) of a sparse file; counts are checked."""
    kind = matrix_kind(spark, path)
    head = _head(spark, path, 4)
    n, d = int(head[1]), int(head[2])
    skip = 4 if len(head) > 3 and not _is_row(head[3], d, kind) else 3
    start = _first_file(spark, path)
    lines = spark.read.text(path).where("value <> ''").select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_m"))
    first = [r["_m"] for r in lines.where(F.replace("_file", F.lit("///"), F.lit("/")) == start.replace("///", "/")).orderBy("_m").limit(skip).collect()]
    numbered = lines.where(~F.col("_m").isin(first))
    parts = F.split("value", ";")
    last = F.element_at(parts, -1)
    klass = last.try_cast("double") if kind[1] == "Y" else F.lit(None).cast("double")
    body = F.slice(parts, F.lit(2), F.size(parts) - (2 if kind[1] == "Y" else 1))
    if kind[0] == "D":
        rows = numbered.select(F.get(parts, F.lit(0)).alias("id"), F.transform(body, lambda x: x.cast("double")).alias("features"), klass.alias("klass"))
        wrong = rows.where(F.size("features") != d)
    else:
        pair = lambda x: F.struct(F.split(x, ":")[0].cast("int"), F.split(x, ":")[1].cast("double"))
        rows = numbered.select(F.get(parts, F.lit(0)).alias("id"), F.map_from_entries(F.transform(F.filter(body, lambda x: x.contains(":")), pair)).alias("cells"), klass.alias("klass"))
        wrong = rows.where(F.exists(F.map_keys("cells"), lambda k: (k < 0) | (k >= d)))
    if rows.count() != n or not wrong.isEmpty():
        raise ValueError(f"{path}: rows do not fit the head ({n} rows of {d})")
    return rows


def _is_row(line: str, d: int, kind: str) -> bool:
    cells = line.split(";")
    return ":" in line if kind[0] == "S" else len(cells) == d + (2 if kind[1] == "Y" else 1) and all(_number(c) for c in cells[1:])


def _number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def dense_lines(rows: DataFrame, with_class: bool = True) -> DataFrame:
    """One text line a row of (id, features, klass)."""
    cells = [F.col("id").cast("string"), F.array_join(F.transform("features", lambda x: x.cast("string")), ";")]
    return rows.select(F.concat_ws(";", *cells, *([F.coalesce(F.col("klass"), F.lit(0.0)).cast("string")] if with_class else [])).alias("value"))


def sparse_lines(rows: DataFrame, with_class: bool = True) -> DataFrame:
    """One text line a row of (id, cells map, klass), cells in ascending order."""
    entries = F.array_sort(F.map_entries("cells"))
    cells = [F.col("id").cast("string"), F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ";")]
    return rows.select(F.concat_ws(";", *cells, *([F.coalesce(F.col("klass"), F.lit(0.0)).cast("string")] if with_class else [])).alias("value"))


def write_matrix(rows: DataFrame, path: str, kind: str, dims: int) -> None:
    """Head and lines as text; the head comes first in the single first file."""
    n = rows.count()
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, kind), (1, str(n)), (2, str(dims))], "k int, value string").coalesce(1).orderBy("k").select("value")
    lines = (dense_lines if kind[0] == "D" else sparse_lines)(rows, kind[1] == "Y")
    head.union(lines).write.mode("overwrite").text(path)


def write_projection(places: DataFrame, path: str) -> None:
    """Places (id, x, y) as a dense matrix file of two columns."""
    write_matrix(places.select("id", F.array("x", "y").alias("features"), F.lit(0.0).alias("klass")), path, "DY", 2)
