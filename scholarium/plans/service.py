"""Requests of the explorer: search, zoom, references, export."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.functions.strings import author_names, csv_cell
from scholarium.operators.density import bandwidth, density_grid
from scholarium.operators.graph import references_within
from scholarium.operators.spatial import in_rectangle
from scholarium.operators.text import build_query, matches, to_vector, vector_map

SIMPLE = ("doc_id", "doi", "title", "authors", "keywords", "publication_date", "x", "y", "rank", "relevance_doc", "relevance_aut")


def simple_documents(documents: DataFrame, data: DataFrame, words: int = 10, enabled_only: bool = True) -> DataFrame:
    """Documents with their place and rank, ``tsv`` for matching, the most frequent words and parsed names."""
    one = data.where("rank IS NOT NULL AND NOT isnan(rank)").groupBy("doc_id").agg(*[F.first(c).alias(c) for c in ("x", "y", "rank", "relevance_doc", "relevance_aut")])
    kept = documents.where("enabled") if enabled_only else documents
    joined = kept.select("doc_id", "doi", "title", "authors", "keywords", "publication_date", "tsv", "words", "bibtex").join(one, "doc_id")
    return joined.withColumns({"words": F.slice("words", 1, words), "names": author_names(F.col("authors"))})


def by_author(documents: DataFrame, text: str, authors: DataFrame, links: DataFrame, operator: str = "and", distinct: bool = True) -> DataFrame:
    """Documents with an author whose name matches; ``distinct`` False repeats a document per matching author."""
    query = build_query(text, operator)
    hit = authors.where(matches(query, vector_map(to_vector(F.col("aut_name"))))).select("aut_id")
    ids = links.where("doc_id IS NOT NULL").select("doc_id", "aut_id").distinct().join(hit, "aut_id").select("doc_id")
    return documents.join(ids, "doc_id", "left_semi" if distinct else "inner")


def in_years(documents: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Inclusive bounds, each optional; year 0 passes an upper bound alone."""
    if first is not None:
        documents = documents.where(F.col("publication_date") >= first)
    return documents if last is None else documents.where(F.col("publication_date") <= last)


def page_of(matched: DataFrame, size: int, page: int = 0) -> DataFrame:
    """One page by falling rank, then id: a top-k, not a sort of everything."""
    return matched.orderBy(F.desc("rank"), "doc_id").offset(page * size).limit(size)


def rest_after(matched: DataFrame, size: int, page: int = 0) -> DataFrame:
    """The points after a page, in no order; the last row of the page is the only thing the driver sees."""
    last = matched.select("rank", "doc_id").orderBy(F.desc("rank"), "doc_id").offset((page + 1) * size - 1).limit(1).collect()
    if not last:
        return matched.limit(0)
    rank, key = last[0]
    return matched.where((F.col("rank") < rank) | ((F.col("rank") == rank) & (F.col("doc_id") > key)))


@dataclass
class Answer:
    """A page at once; the grid of the rest and the number of matches only when asked for."""

    documents: DataFrame
    matched: DataFrame
    box: tuple[float, float, float, float]
    size: int
    page: int
    query: str | None
    operation: str

    @cached_property
    def rest(self) -> DataFrame:
        return rest_after(self.matched, self.size, self.page)

    @cached_property
    def grid(self) -> DataFrame:
        rest = self.rest.select("x", "y")
        return density_grid(rest, self.box, bandwidth(rest))

    @cached_property
    def ndocs(self) -> int:
        return self.matched.count()


def search(tables: dict[str, DataFrame], terms: str | None = None, operator: str = "or", author: str | None = None, year_start: int | None = None, year_end: int | None = None, max_docs: int = 100, page: int = 0, start: tuple[float, float] | None = None, end: tuple[float, float] | None = None) -> Answer:
    """A search, or with two corners a zoom: a page of documents and the density of the rest."""
    query = build_query(terms, operator)
    found = simple_documents(tables["documents"], tables["documents_data"])
    found = found.where(matches(query, F.col("tsv")))
    found = in_years(found, year_start, year_end)
    if author and author.strip():
        found = by_author(found, author, tables["authors"], tables["document_authors"])
    box = (-1.0, -1.0, 1.0, 1.0)
    zoom = start is not None and end is not None
    if zoom:
        found = in_rectangle(found, start, end)
        box = (min(start[0], end[0]), min(start[1], end[1]), max(start[0], end[0]), max(start[1], end[1]))
    return Answer(page_of(found, max_docs, page), found, box, max_docs, page, query, "zoom" if zoom else "search")


def answer_json(answer: Answer, max_docs: int) -> DataFrame:
    """One row of JSON a shown document, for the web layer."""
    return answer.documents.select("doc_id", F.to_json(F.struct(*SIMPLE, "names", "words")).alias("json")).limit(max_docs)


def word_cloud(shown: DataFrame) -> DataFrame:
    """(text, size): words of the shown documents added up; longer than two letters, or 2d and 3d."""
    words = shown.select(F.explode("words").alias("w")).select(F.col("w.word").alias("text"), F.col("w.nentry").alias("size"))
    return words.where((F.length("text") > 2) | F.lower("text").isin("2d", "3d")).groupBy("text").agg(F.sum("size").cast("long").alias("size"))


def references(citations: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, json) with the cited ids among the shown documents."""
    return references_within(citations, ids).select("doc_id", F.to_json("refs").alias("json"))


def export_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line) of the CSV export: DOI, title, authors, year and BibTeX, all quoted."""
    cells = [csv_cell(F.col(c)) for c in ("doi", "title", "authors", "publication_date", "bibtex")]
    return documents.where("enabled").select("doc_id", F.concat_ws(",", *cells).alias("line"))


EXPORT_HEADER = "DOI,Title,Authors,Year,BibTEX"


def pages(n_documents: int, max_docs: int, page: int) -> dict[str, int]:
    """Pagination: full pages, and the first and last place of a page."""
    return {"pages": n_documents // max_docs, "first": page * max_docs + 1, "last": min((page + 1) * max_docs, n_documents)}
