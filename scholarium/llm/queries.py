"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.llm import distinctive, fusion_rank, leakage, lookalike, names, packing, survivor
from scholarium.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.found(table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.found(table(spark, d, "authors"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.found(table(spark, d, "documents"), table(spark, d, "source_trust"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion_rank.found(table(spark, d, "documents_data"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_budgets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found(table(spark, d, "documents"))


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    """BM25 weight of every word of every record."""
    return distinctive.distinctive_terms(table(spark, d, "documents")).select("doc_id", "word", F.round("score", 6).alias("score"))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(table(spark, d, "authors"))


def p4_fused(spark: SparkSession, d: str) -> DataFrame:
    """The fused values of each work, chosen by posterior."""
    return survivor.best_records(table(spark, d, "documents"), table(spark, d, "source_trust"))


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All documents in the one order by the principal component of their ranks."""
    return fusion_rank.ranking(table(spark, d, "documents_data"), "doc_id", fusion_rank.SCORES)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    budgets = table(spark, d, "pack_budgets")
    return packing.fill(packing.pack(table(spark, d, "documents"), budgets), budgets)


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Copied and reworded items with cosine, length of the stretch and share in common."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_classes(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p1_scores, p2_found, p2_entities, p4_found, p4_fused, p5_found, p5_ranking, p6_pack, p6_fill, p7_found, p7_leaks, p8_found, p8_classes)
    return {q.__name__: q for q in every}


_USED = """
WITH vector AS (
  SELECT doc_id, lower(e.key) AS word, len(e.value) AS n
  FROM (SELECT doc_id, unnest(map_entries(tsv)) AS e FROM documents WHERE tsv IS NOT NULL)
), counts AS (
  SELECT doc_id, lower(f.word) AS word, coalesce(f.nentry, 0) AS n
  FROM (SELECT doc_id, unnest(freqs) AS f FROM documents WHERE tsv IS NULL AND freqs IS NOT NULL)
), used AS (
  SELECT doc_id, word, sum(n) AS tf
  FROM (SELECT * FROM vector UNION ALL SELECT * FROM counts)
  WHERE word IS NOT NULL AND n > 0 GROUP BY doc_id, word
), df AS (SELECT word, count(*) AS df FROM used GROUP BY word)
"""
P1_FOUND = f"{_USED} SELECT doc_id, word FROM used JOIN df USING (word) WHERE tf >= 3 AND df BETWEEN 2 AND 8"
P1_SCORES = f"""{_USED}, size AS (SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS length FROM used GROUP BY doc_id),
all_docs AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT avg(length) FROM size) AS mean)
SELECT doc_id, word, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score
FROM used JOIN df USING (word) JOIN size USING (doc_id), all_docs
"""

P5_FOUND = """
WITH d AS (
  SELECT doc_id, max(CASE WHEN NOT isnan(relevance_doc) THEN relevance_doc END) AS a,
         max(CASE WHEN NOT isnan(relevance_aut) THEN relevance_aut END) AS b,
         max(CASE WHEN NOT isnan(rank) THEN rank END) AS c
  FROM documents_data GROUP BY doc_id
), ra AS (SELECT doc_id, rank() OVER (ORDER BY a DESC) - 1 AS up, count(*) OVER () AS n FROM d WHERE a IS NOT NULL),
   rb AS (SELECT doc_id, rank() OVER (ORDER BY b DESC) - 1 AS up, count(*) OVER () AS n FROM d WHERE b IS NOT NULL),
   rc AS (SELECT doc_id, rank() OVER (ORDER BY c DESC) - 1 AS up, count(*) OVER () AS n FROM d WHERE c IS NOT NULL)
SELECT doc_id FROM ra JOIN rb USING (doc_id) JOIN rc USING (doc_id)
WHERE ra.up < 0.1 * ra.n AND rb.up < 0.1 * rb.n AND rc.up < 0.1 * rc.n
"""

_MEAN_RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 - 0.5) / count(*) OVER ()"
P5_RANKING = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, max(CASE WHEN NOT isnan(relevance_doc) THEN relevance_doc END) AS a,
         max(CASE WHEN NOT isnan(relevance_aut) THEN relevance_aut END) AS b,
         max(CASE WHEN NOT isnan(rank) THEN rank END) AS c
  FROM documents_data WHERE doc_id IS NOT NULL GROUP BY doc_id
), ra AS (SELECT doc_id, {_MEAN_RANK.format(c="a")} AS x FROM d WHERE a IS NOT NULL),
   rb AS (SELECT doc_id, {_MEAN_RANK.format(c="b")} AS y FROM d WHERE b IS NOT NULL),
   rc AS (SELECT doc_id, {_MEAN_RANK.format(c="c")} AS z FROM d WHERE c IS NOT NULL),
   r AS (SELECT doc_id, x, y, z FROM d LEFT JOIN ra USING (doc_id) LEFT JOIN rb USING (doc_id) LEFT JOIN rc USING (doc_id)),
   m AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r),
   power AS (
     SELECT 0 AS step, CAST(1 AS DOUBLE) AS u, CAST(1 AS DOUBLE) AS v, CAST(1 AS DOUBLE) AS w
     UNION ALL
     SELECT step + 1, nu / sqrt(nu * nu + nv * nv + nw * nw), nv / sqrt(nu * nu + nv * nv + nw * nw), nw / sqrt(nu * nu + nv * nv + nw * nw)
     FROM (SELECT step, u + xy * v + xz * w AS nu, xy * u + v + yz * w AS nv, xz * u + yz * v + w AS nw FROM power, m WHERE step < 3000)
   ), loading AS (SELECT u, v, w FROM power WHERE step = 3000),
   s AS (SELECT doc_id, round((coalesce(x, 0.5) - 0.5) * u + (coalesce(y, 0.5) - 0.5) * v + (coalesce(z, 0.5) - 0.5) * w, 6) + 0.0 AS combined FROM r, loading)
SELECT doc_id, combined, row_number() OVER (ORDER BY combined DESC, doc_id) AS place FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_scores": P1_SCORES, "p5_found": P5_FOUND, "p5_ranking": P5_RANKING}
