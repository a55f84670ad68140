"""Text forms shared by comparisons: accents off, letters only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that have no decomposition, and their plain form.
UNDECOMPOSED = {
    "ł": "l", "ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ŀ": "l", "ŋ": "n", "œ": "oe", "æ": "ae", "ß": "ss", "þ": "th", "ŧ": "t",
}


def letters_only(col: Column) -> Column:
    """Lower-case letters and digits of the text without anything else; null stays null.

    German sharp s is spelled out, so capitals and small letters compare equal.
    """
    return F.regexp_replace(F.replace(F.lower(col), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", "")
