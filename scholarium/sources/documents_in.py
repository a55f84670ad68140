"""Where records come from: PDF folders and packages, web pages, catalogue JSON."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the PDFs directly in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "false").load(folder).select("path", "content")


def pdf_packages(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the PDFs inside ZIP packages; a broken package gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for entry in z.namelist():
                            if entry.lower().endswith(".pdf"):
                                yield pd.DataFrame({"path": [f"{name}!{entry}"], "content": [z.read(entry)]})
                except zipfile.BadZipFile:
                    continue

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, content binary")


def parse_headers(files: DataFrame, parser: Callable[[bytes], dict | None]) -> DataFrame:
    """Header fields of files by an outside parser; a record needs title and authors, or a DOI. Errors skip the file."""
    fields = ["title", "authors", "doi", "abstract", "keywords"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    got = parser(content) or {}
                except Exception:  # noqa: BLE001 - one bad file must not end the job
                    continue
                rows.append([path, *[got.get(f) for f in fields]])
            yield pd.DataFrame(rows, columns=["path", *fields])

    rows = files.mapInPandas(run, "path string, " + ", ".join(f"{f} string" for f in fields))
    return rows.where("(title IS NOT NULL AND authors IS NOT NULL) OR doi IS NOT NULL")


# Names of meta elements and the field they fill.
META = {
    "citation_journal_title": "container", "citation_publication_date": "date", "dc.date": "date", "citation_volume": "volume", "citation_issue": "issue",
    "citation_author": "authors", "citation_authors": "authors", "dc.creator": "authors", "dc.contributor": "authors", "author": "authors",
    "citation_abstract": "abstract", "dc.description": "abstract", "description": "abstract", "meta:description": "abstract", "og:description": "abstract",
    "citation_title": "title", "dc.title": "title", "citation_keyword": "keywords", "citation_keywords": "keywords", "dc.subject": "keywords", "keywords": "keywords",
}
_LISTS = ("authors", "keywords")
HTML_FIELDS = T.StructType([T.StructField(f, T.StringType()) for f in ("title", "authors", "keywords", "abstract", "container", "date", "volume", "issue")])


class _Meta(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.got: dict[str, str] = {}
        self.depth, self.text = 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "meta":
            field = META.get((a.get("name") or a.get("property") or "").lower())
            value = (a.get("content") or "").strip()
            if field and value:
                if field in _LISTS:
                    parts = [p.strip() for p in value.split(";") if p.strip()]
                    self.got[field] = ";".join(([self.got[field]] if field in self.got else []) + parts)
                else:
                    self.got[field] = value
        elif self.depth:
            self.depth += tag not in ("br", "img", "hr", "input", "link")
        elif {"abstract", "Abstract"} & set((a.get("class") or "").split()):
            self.depth = 1

    def handle_endtag(self, tag: str) -> None:
        if self.depth:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.depth:
            self.text.append(data)


def page_fields(html: str | None) -> dict[str, str | None]:
    """Bibliographic fields of a page: meta elements, else the text of its abstract element."""
    m = _Meta()
    m.feed(html or "")
    if "abstract" not in m.got and (text := " ".join("".join(m.text).split())):
        m.got["abstract"] = text
    return {f.name: m.got.get(f.name) for f in HTML_FIELDS}


def html_fields(html: Column) -> Column:
    """struct of the fields of a page column."""

    @F.pandas_udf(HTML_FIELDS)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_fields(p) for p in pages], columns=HTML_FIELDS.names)

    return run(html)


# Kinds of catalogue items and the kind kept here; every kind of book is a book, other kinds have none.
ITEM_KINDS = {
    "book": "book", "book-section": "book", "book-track": "book", "book-part": "book", "book-set": "book", "book-chapter": "book", "book-series": "book",
    "journal-article": "article", "journal-volume": "periodical", "journal-issue": "periodical", "journal": "periodical",
    "proceedings-article": "inproceedings", "report": "techreport", "monograph": "mastersthesis", "dissertation": "phdthesis",
}
CATALOGUE = "array<struct<title:string,type:string,year:int,source:string,volume:string,issue:string,pages:string,abstract:string,keywords:array<string>,authors:array<struct<first_name:string,last_name:string>>,identifiers:struct<doi:string,issn:string>>>"


def catalogue_records(lines: DataFrame, column: str = "json") -> DataFrame:
    """One bibliographic row per item of JSON lists; lines that are no list give none."""
    items = lines.select(F.explode(F.from_json(column, CATALOGUE)).alias("i")).select("i.*")
    kind = F.create_map(*[F.lit(x) for kv in ITEM_KINDS.items() for x in kv])
    names = F.transform("authors", lambda a: F.concat_ws(" ", a["first_name"], a["last_name"]))
    return items.select(
        "title", F.col("identifiers.doi").alias("doi"), F.col("identifiers.issn").alias("container_issn"), F.try_element_at(kind, F.col("type")).alias("type"),
        F.coalesce("year", F.lit(0)).alias("publication_date"), F.col("source").alias("publisher"), "volume", "issue", "pages", "abstract",
        F.array_join("keywords", ", ").alias("keywords"), F.array_join(names, ";").alias("authors"),
    )


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, **options: str) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric key where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()
