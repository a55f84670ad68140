"""One consistent form for texts that look the same."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.plans.lineage import cut

# Letters of other alphabets, and the Latin letter that they look like.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "ѵ": "v", "г": "r",
    # Armenian
    "ս": "u", "օ": "o", "հ": "h", "ո": "n", "զ": "q", "ց": "g", "Օ": "O", "Ս": "U",
    # Latin letters of phonetic use, dotless i, and others
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʋ": "v", "ʏ": "y", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꓐ": "B",
    # hyphens and dots
    "‐": "-", "‑": "-", "․": ".", "ꞏ": "·", "‧": "·",
}

# Code points that a reader never sees (default-ignorable), as ranges.
IGNORABLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
#: Decompositions that leave the look as it is; a raised or lowered sign, a fraction or a circle is seen.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>"}
LINE_ENDS = {"\r", "\x0b", "\x0c", "\x85", " ", " "}
SEEN_ANYWAY = {"ſ"}


def _look(ch: str) -> str:
    """What one character looks like, as the plainest characters of the same look."""
    point = ord(ch)
    if any(a <= point <= b for a, b in IGNORABLE):
        return ""
    if ch in LINE_ENDS:
        return "\n"
    if ch == "\t" or unicodedata.category(ch) == "Zs":
        return " "
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0] in SAME_LOOK and ch not in SEEN_ANYWAY:
        return "".join(_look(chr(int(p, 16))) for p in parts[1:])
    return ch


class _Table(dict):
    """For str.translate: fills itself, one entry per character ever met."""

    def __missing__(self, point: int) -> str:
        self[point] = value = _look(chr(point))
        return value


_TABLE = _Table()
_BLANKS, _ENDS = re.compile(r"[ ]{2,}"), re.compile(r" *\n *")


def visual_form(text: str) -> str:
    """The text as a reader sees it: look-alikes, widths, ligatures and spaces made alike, the unseen removed.

    Letter case, accents, raised digits, marks and line breaks stay. Runs of blanks become one; blanks
    beside a line break or at an end go, since nobody sees how many there are.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFD", text.replace("\r\n", "\n")).translate(_TABLE)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
    elif "\r" in text or "\t" in text or "\x0b" in text or "\x0c" in text:
        text = text.replace("\r\n", "\n").translate(_TABLE)
    if "  " in text:
        text = _BLANKS.sub(" ", text)
    if " \n" in text or "\n " in text:
        text = _ENDS.sub("\n", text)
    return text.strip(" ")


def consistent_form(text: str) -> str:
    """The form that comparisons should use: compatibility composition, full case folding, blanks mapped, the unseen removed."""
    text = visual_form(text)
    if text.isascii():
        return text.lower()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return folded.translate(_TABLE)


def _per_distinct(values: pd.Series, f) -> pd.Series:
    """f once per distinct value of the batch."""
    codes, distinct = pd.factorize(values)
    done = pd.Series([f(v) for v in distinct], dtype=object)
    out = done.reindex(codes).reset_index(drop=True)
    out.index = values.index
    return out.where(values.notna(), None)


@lru_cache(maxsize=1)
def _consistent_udf():
    @F.pandas_udf(T.StringType())
    def consistent(values: pd.Series) -> pd.Series:
        return _per_distinct(values, consistent_form)

    return consistent


def consistent(col: Column | str) -> Column:
    """Column of the consistent form; null stays null, an empty text empty, whatever the length."""
    return _consistent_udf()(col)


_PRINTS = T.StructType([T.StructField("form", T.BinaryType()), T.StructField("look", T.BinaryType()), T.StructField("raw", T.BinaryType())])


def _prints(text: str) -> tuple[bytes, bytes, bytes] | None:
    look = visual_form(text)
    if not look.strip("\n "):
        return None
    form = look.lower() if look.isascii() else consistent_form(text)
    return tuple(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in (form, look, text))


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, look, raw): 128-bit prints of the consistent form, of the visual form and of the stored text.

    Null texts and texts in which nothing is seen give no row.
    """

    @F.pandas_udf(_PRINTS)
    def prints(values: pd.Series) -> pd.DataFrame:
        done = _per_distinct(values, _prints)
        return pd.DataFrame([x or (None, None, None) for x in done], columns=["form", "look", "raw"])

    rows = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key), prints(F.col(text)).alias("p"))
    return rows.select(key, "p.form", "p.look", "p.raw").where("form IS NOT NULL")


def look_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class, spelling, n_spellings): rows whose text looks like that of another row and differs from it as stored.

    ``class`` is the smallest key of the rows that look alike, ``spelling`` the smallest key of the rows
    stored alike. Rows meet through the print of the consistent form; among those the looks must be
    equal. All steps are aggregations with one row a stored spelling, so many copies of one string cost no more than one.
    """
    rows = cut(fingerprints(documents, key, text))  # a few bytes a row, so that the texts are read once
    spellings = rows.groupBy("form", "look", "raw").agg(F.min(key).alias("spelling"))
    classes = spellings.groupBy("form", "look").agg(F.min("spelling").alias("class"), F.count(F.lit(1)).alias("n_spellings")).where("n_spellings > 1")
    members = rows.join(spellings.join(classes, ["form", "look"]).select("raw", "spelling", "class", "n_spellings"), "raw")
    return members.select(key, "class", "spelling", "n_spellings").distinct()


def found(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): rows whose texts look the same and yet differ as stored.

    The pairs asked for are those of ``look_classes``: first the spellings of a class are paired, then each
    pair of spellings is spelled out by its rows, so rows stored alike never meet.
    """
    rows = cut(look_classes(documents))
    spellings = rows.select("class", "spelling").distinct()
    pairs = spellings.select("class", F.col("spelling").alias("lo")).join(spellings.select("class", F.col("spelling").alias("hi")), "class").where("lo < hi")
    a, b = rows.select(F.col("spelling").alias("lo"), F.col("doc_id").alias("a")), rows.select(F.col("spelling").alias("hi"), F.col("doc_id").alias("b"))
    return pairs.join(a, "lo").join(b, "hi").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
