"""Upserts, links, deletions and merges, as pure functions of DataFrames (no table has a MERGE)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.functions.visible import letters_only
from scholarium.operators.prefix import numbered


def is_complete(title="title", keywords="keywords", abstract="abstract"):
    """Whether any of title, keywords and abstract is not blank."""
    filled = [F.coalesce(F.trim(F.col(c)) != "", F.lit(False)) for c in (title, keywords, abstract)]
    return filled[0] | filled[1] | filled[2]


def upsert_documents(rows: DataFrame, arrival: str, key: str = "doi", id_column: str = "doc_id") -> DataFrame:
    """One row per key: each field is the first non-null in order of ``arrival``; rows without a key stay apart.

    ``rows`` holds stored and new records. The id is the first one that has arrived. Partial aggregation
    leaves one row per key and task to shuffle, so a much repeated key is no hot spot.
    """
    others = [c for c in rows.columns if c not in (key, arrival, id_column)]
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(arrival, id_column)))
    merged = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(id_column, F.struct(arrival, id_column)).alias(id_column), *[first(c).alias(c) for c in others])
    columns = [id_column, key, *others]
    return merged.select(columns).union(rows.where(F.col(key).isNull()).select(columns))


def upsert_authors(stored: DataFrame, names: DataFrame) -> DataFrame:
    """(aut_id, aut_name): stored authors and new names, which get ids after the largest in order of name."""
    new = names.select("aut_name").where("aut_name IS NOT NULL").distinct().join(stored.select("aut_name"), "aut_name", "left_anti")
    top = stored.agg(F.coalesce(F.max("aut_id"), F.lit(0))).first()[0]
    places = numbered(new, "aut_name", "_n")
    return stored.select("aut_id", "aut_name").union(places.select((F.lit(top) + 1 + F.col("_n")).alias("aut_id"), "aut_name"))


def link_authors(links: DataFrame) -> DataFrame:
    """Each (doc_id, aut_id) once, under its smallest id; rows without an author are no link."""
    return links.where("doc_id IS NOT NULL AND aut_id IS NOT NULL").groupBy("doc_id", "aut_id").agg(F.min("id").alias("id")).select("id", "doc_id", "aut_id")


def link_citations(citations: DataFrame) -> DataFrame:
    """Each (doc_id, ref_id) once, under its smallest id; no self citation."""
    kept = citations.where("doc_id IS NOT NULL AND ref_id IS NOT NULL AND doc_id <> ref_id")
    return kept.groupBy("doc_id", "ref_id").agg(F.min("id").alias("id")).select("id", "doc_id", "ref_id")


def cite(citations: DataFrame, documents: DataFrame, references: DataFrame, key: str = "doi", id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents with the cited records that were not stored, links): ``references`` is (doc_id, and the fields of a cited record with its key).

    A cited record without a key cannot be told from others and is neither stored nor linked. New records get ids after the
    largest in order of their key. Links already in ``citations`` and self citations are not given again.
    """
    fields = [c for c in references.columns if c not in (id_column, key)]
    cited = references.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(c).alias(c) for c in fields])
    new = cited.join(documents.select(key), key, "left_anti")
    top = documents.agg(F.coalesce(F.max(id_column), F.lit(0))).first()[0]
    made = numbered(new, key, "_n").withColumn(id_column, F.lit(top) + 1 + F.col("_n"))
    stored = documents.unionByName(made.select(id_column, key, *[c for c in fields if c in documents.columns]), allowMissingColumns=True)
    ids = stored.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_column).alias("ref_id"))
    links = references.select(id_column, key).join(ids, key).select(F.col(id_column).alias("doc_id"), "ref_id").where("doc_id <> ref_id").distinct()
    return stored, links.join(citations.select("doc_id", "ref_id"), ["doc_id", "ref_id"], "left_anti")


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the documents of ``ids`` (doc_id) and without what hangs on them."""
    gone = ids.select("doc_id").distinct()
    out = {name: t.join(gone, "doc_id", "left_anti") for name, t in tables.items()}
    if "citations" in out:
        out["citations"] = out["citations"].join(gone.withColumnRenamed("doc_id", "ref_id"), "ref_id", "left_anti").select(tables["citations"].columns)
    return out


def disable_documents(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``enabled`` is false for the documents of ``ids``."""
    marked = ids.select("doc_id").distinct().withColumn("_off", F.lit(True))
    return documents.join(marked, "doc_id", "left").withColumn("enabled", F.when(F.col("_off"), False).otherwise(F.col("enabled"))).drop("_off")


def update_columns(rows: DataFrame, news: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` replaced by those of ``news`` where the key has a row there."""
    fresh = news.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = rows.join(fresh, key, "left")
    kept = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return joined.select(*kept)


def fill_missing(records: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Null fields of ``records`` taken from the row of ``source`` with the same key (web page, catalogue); others stay."""
    got = source.select(F.col(key), *[F.col(c).alias(f"_src_{c}") for c in columns])
    joined = records.join(got, key, "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_src_{c}")).alias(c) if c in columns else F.col(c) for c in records.columns])


def lookup(records: DataFrame, catalogue: DataFrame, by: list[str], columns: list[str], key: str = "doc_id") -> DataFrame:
    """``columns`` of each record filled from the catalogue entry whose ``by`` fields read the same.

    Fields are compared by their letters and digits in lower case. Records and entries with a null or
    empty ``by`` field match nothing; of several entries the smallest wins, so no record is doubled.
    """
    form = lambda c: F.nullif(letters_only(F.col(c).cast("string")), F.lit(""))
    forms = {f"_by_{c}": form(c) for c in by}
    known = catalogue.withColumns(forms).dropna(subset=list(forms)).groupBy(*forms).agg(F.min(F.struct(*columns)).alias("_got"))
    joined = records.withColumns(forms).join(known, list(forms), "left")
    return joined.select(key, *[F.coalesce(F.col(c), F.col(f"_got.{c}")).alias(c) if c in columns else F.col(c) for c in records.columns if c != key])


def references_of(parsed: DataFrame) -> DataFrame:
    """One row per cited record of (doc_id, doi, references array<struct<doi,...>>), without a document's own DOI."""
    rows = parsed.select("doc_id", "doi", F.explode("references").alias("ref"))
    return rows.where(F.coalesce(F.col("ref.doi") != F.col("doi"), F.lit(True))).select("doc_id", "ref.*")


def with_data_rows(documents: DataFrame, data: DataFrame) -> DataFrame:
    """One data row per document; zeros where none is stored. Rows delivered twice count once."""
    scores = ["x", "y", "relevance_doc", "relevance_aut", "rank"]
    one = data.dropDuplicates(["doc_id"])
    joined = documents.select("doc_id").join(one, "doc_id", "left")
    return joined.select("doc_id", "node_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in scores])
