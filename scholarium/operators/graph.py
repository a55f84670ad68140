"""Citation graphs and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.operators.ingest import link_authors, link_citations
from scholarium.plans.lineage import bucketed, cut


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()


def citation_edges(citations: DataFrame) -> DataFrame:
    """(src, dst), each citation once."""
    return link_citations(citations).select(F.col("doc_id").alias("src"), F.col("ref_id").alias("dst"))


def author_edges(citations: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, weight): authors citing authors with the number of citations between them; self loops stay."""
    cites, by = citation_edges(citations), link_authors(links)
    a = by.select(F.col("doc_id").alias("src_doc"), F.col("aut_id").alias("src"))
    b = by.select(F.col("doc_id").alias("dst_doc"), F.col("aut_id").alias("dst"))
    joined = cites.withColumnsRenamed({"src": "src_doc", "dst": "dst_doc"}).join(a, "src_doc").join(b, "dst_doc")
    return joined.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def pagerank(edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-7, max_iter: int = 50, cut_every: int = 5) -> DataFrame:
    """(v, pr): damping ``alpha``; an edge of weight w counts w times; the mass of dead ends is lost.

    Stops when the Euclidean change falls below ``tolerance`` (0: never) or after ``max_iter`` steps. The
    edges with their shares are written once, bucketed by source, so that a step moves ranks to the
    edges and never the edges; a partial aggregation by target follows, so a much cited vertex is no
    hot spot. An empty graph gives no rows.
    """
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    base = edges.select("src", "dst", weight.cast("double").alias("w"))
    out = base.groupBy("src").agg(F.sum("w").alias("degree"))
    shares = bucketed(base.join(out, "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("share")), "src")
    points = cut(vertices(base))
    n = points.count()
    if n == 0:
        return points.withColumn("pr", F.lit(0.0))
    rank = points.withColumn("pr", F.lit(1.0 / n))
    for step in range(1, max_iter + 1):
        flow = shares.join(rank.withColumnRenamed("v", "src"), "src").groupBy("dst").agg(F.sum(F.col("pr") * F.col("share") * alpha).alias("flow"))
        new = points.join(flow.withColumnRenamed("dst", "v"), "v", "left").select("v", (F.lit((1 - alpha) / n) + F.coalesce("flow", F.lit(0.0))).alias("pr"))
        if tolerance > 0:
            new = cut(new)
            moved = new.join(rank.withColumnRenamed("pr", "old"), "v").agg(F.sqrt(F.sum((F.col("pr") - F.col("old")) * (F.col("pr") - F.col("old"))))).first()[0]
            rank = new
            if moved < tolerance:
                break
        else:
            rank = cut(new) if step % cut_every == 0 and step < max_iter else new
    return rank


def pagerank_by_jump(edges: DataFrame, jump: float = 0.15, tolerance: float = 1e-3, max_iter: int = 100) -> DataFrame:
    """(v, pr) of the variant with a jump probability: parallel edges count once, and what dead ends hold is dealt to all vertices.

    Stops when no rank moves by ``tolerance`` or more (0: never) or after ``max_iter`` steps.
    """
    base = edges.select("src", "dst").distinct()
    shares = bucketed(base.join(base.groupBy("src").agg(F.count(F.lit(1)).alias("k")), "src").select("src", "dst", (F.lit(1.0) / F.col("k")).alias("share")), "src")
    points = cut(vertices(base).join(base.select(F.col("src").alias("v"), F.lit(True).alias("_goes_on")).distinct(), "v", "left"))
    n = points.count()
    if n == 0:
        return points.select("v", F.lit(0.0).alias("pr"))
    rank = points.withColumn("pr", F.lit(1.0 / n))
    for _ in range(max_iter):
        lost = rank.where("_goes_on IS NULL").agg(F.coalesce(F.sum("pr"), F.lit(0.0))).first()[0]
        flow = shares.join(rank.select(F.col("v").alias("src"), "pr"), "src").groupBy("dst").agg(F.sum(F.col("pr") * F.col("share")).alias("flow"))
        new = cut(points.join(flow.withColumnRenamed("dst", "v"), "v", "left").select("v", "_goes_on", (F.lit((jump + (1 - jump) * lost) / n) + (1 - jump) * F.coalesce("flow", F.lit(0.0))).alias("pr")))
        moved = new.join(rank.select("v", F.col("pr").alias("old")), "v").agg(F.max(F.abs(F.col("pr") - F.col("old")))).first()[0]
        rank = new
        if moved < tolerance:
            break
    return rank.select("v", "pr")


def combined_rank(relevance: DataFrame, author_relevance: DataFrame, links: DataFrame, doc_factor: float = 1.0, author_factor: float = 0.0) -> DataFrame:
    """(doc_id, relevance_aut, rank) of documents with authors: both relevances weighted and added up."""
    per_doc = link_authors(links).join(author_relevance.select("aut_id", "relevance"), "aut_id").groupBy("doc_id").agg(F.sum(F.coalesce("relevance", F.lit(0.0))).alias("relevance_aut"))
    joined = per_doc.join(relevance.select("doc_id", F.coalesce(F.nanvl("relevance_doc", F.lit(0.0)), F.lit(0.0)).alias("r")), "doc_id")
    return joined.select("doc_id", "relevance_aut", (doc_factor * F.col("r") + author_factor * F.col("relevance_aut")).alias("rank"))


def document_graph(citations: DataFrame, documents: DataFrame, data: DataFrame) -> DataFrame:
    """One row per citation with titles and ranks of both ends."""
    ends = documents.select("doc_id", "title").join(data.dropDuplicates(["doc_id"]).select("doc_id", "rank"), "doc_id")
    a = ends.withColumnsRenamed({"doc_id": "src", "title": "src_title", "rank": "src_rank"})
    b = ends.withColumnsRenamed({"doc_id": "dst", "title": "dst_title", "rank": "dst_rank"})
    return citation_edges(citations).join(a, "src").join(b, "dst")


def author_graph(citations: DataFrame, links: DataFrame, authors: DataFrame) -> DataFrame:
    """Author edges with name and relevance of both ends."""
    a = authors.select(F.col("aut_id").alias("src"), F.col("aut_name").alias("src_name"), F.col("relevance").alias("src_relevance"))
    b = authors.select(F.col("aut_id").alias("dst"), F.col("aut_name").alias("dst_name"), F.col("relevance").alias("dst_relevance"))
    return author_edges(citations, links).join(a, "src").join(b, "dst")


def references_within(citations: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, refs): cited ids of each document where both ends are in ``ids`` (doc_id), ascending."""
    wanted = ids.select("doc_id").distinct()
    kept = link_citations(citations).join(wanted, "doc_id", "left_semi").join(wanted.withColumnRenamed("doc_id", "ref_id"), "ref_id", "left_semi")
    return kept.groupBy("doc_id").agg(F.sort_array(F.collect_list("ref_id")).alias("refs"))
