"""String functions of the bibliographic model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize(text: Column) -> Column:
    """Commas, semicolons, full stops, hyphens and square brackets become blanks, two blanks one (once), words capitalised; null gives ''."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"[,;.\-\[\]]", " "), r"\s\s", " ")
    return F.coalesce(F.initcap(F.lower(F.trim(spaced))), F.lit(""))


def author_names(packed: Column) -> Column:
    """Semicolon list to sanitized names; trailing empty entries go; null gives an empty array."""
    parts = F.split(F.regexp_replace(packed, ";+$", ""), ";")
    return F.coalesce(F.transform(parts, sanitize), F.array().cast("array<string>"))


def authors_string(names: Column) -> Column:
    """Each name followed by a semicolon."""
    return F.when(F.size(names) > 0, F.concat(F.array_join(names, ";"), F.lit(";"))).otherwise("")


def extract_year(date: Column) -> Column:
    """The last four digits of a text of word characters only, else the whole text as a number, else 0."""
    digits = F.regexp_extract(date, r"^\w*(\d{4})\w*$", 1)
    return F.coalesce(F.when(digits != "", digits.try_cast("int")), date.try_cast("int"), F.lit(0))


def language_name(_: Column) -> Column:
    return F.lit("english")


def clean_doi(doi: Column) -> Column:
    """Without a leading doi: and without blanks."""
    return F.regexp_replace(F.regexp_replace(doi, r"^\s*(?i)doi:", ""), " ", "")


def first_of(*columns: Column) -> Column:
    """Fallback chain (journal, then book, then event; ISSN, then electronic ISSN; and the like)."""
    return F.coalesce(*columns)


def page_bounds(pages: Column) -> Column:
    """struct(first, last) of a page range a-b; parts that are no numbers are null."""
    parts = F.split(pages, "-")
    return F.struct(F.trim(F.get(parts, F.lit(0))).try_cast("int").alias("first"), F.trim(F.get(parts, F.lit(1))).try_cast("int").alias("last"))


def csv_cell(value: Column) -> Column:
    """Quoted, inner quotes doubled, null as empty."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def container_of(journal: Column, book: Column, event: Column) -> Column:
    """Where a document appeared: journal, else book, else event."""
    return first_of(journal, book, event)


def container_of_reference(journal: Column, event: Column, book: Column) -> Column:
    """Where a cited document appeared: journal, else event, else book."""
    return first_of(journal, event, book)


def issn_of(printed: Column, electronic: Column) -> Column:
    return first_of(printed, electronic)


def pages_of(range_: Column, begin: Column, end: Column) -> Column:
    """The range as it stands, else begin-end."""
    return first_of(range_, F.nullif(F.concat_ws("-", begin, end), F.lit("")))


def year_of(date: Column, year: Column) -> Column:
    """The year of the date, else of the year field; 0 if neither tells."""
    return F.coalesce(F.nullif(extract_year(date), F.lit(0)), extract_year(year))
