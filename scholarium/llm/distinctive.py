"""How distinctive a term is for its record: probabilistic relevance weights (BM25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _merged(words: Column) -> Column:
    """array<struct<word,tf>> -> the same with lower-cased words."""
    return F.transform(words, lambda w: F.struct(F.lower(w["word"]).alias("word"), w["tf"].alias("tf")))


def _terms(vector: str, counts: str) -> Column:
    """array<struct<word,tf>> of a record's uses above zero, one entry a stored spelling."""
    from_vector = F.transform(
        F.map_entries(F.col(vector)),
        lambda e: F.struct(e["key"].alias("word"), F.coalesce(F.size(e["value"]), F.lit(0)).cast("long").alias("tf")),
    )
    from_counts = F.transform(
        F.filter(F.col(counts), lambda e: e.isNotNull()),
        lambda e: F.struct(e["word"].alias("word"), F.coalesce(e["nentry"], F.lit(0)).cast("long").alias("tf")),
    )
    return F.filter(_merged(F.coalesce(from_vector, from_counts)), lambda e: (e["tf"] > 0) & e["word"].isNotNull())


def _length(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0).cast("long"), lambda s, e: s + e["tf"])


def _records(documents: DataFrame, key: str, vector: str, counts: str) -> DataFrame:
    """(key, _uses map<word,tf>, length), one row per record that uses a word; nothing is exploded yet."""
    records = documents.select(F.col(key), _terms(vector, counts).alias("_terms")).where(F.size("_terms") > 0)
    # One record's list is summed inside its row: no shuffle is needed to add up spellings.
    terms, words = F.col("_terms"), F.array_distinct(F.col("_terms.word"))
    as_map = F.when(F.size(words) == F.size(terms), F.map_from_entries(terms)).otherwise(
        F.map_from_arrays(
            words,
            F.transform(words, lambda w: F.aggregate(F.filter(terms, lambda e: e["word"] == w), F.lit(0).cast("long"), lambda s, e: s + e["tf"])),
        )
    )
    return records.select(key, as_map.alias("_uses"), _length(terms).alias("length"))


def record_terms(documents: DataFrame, key: str = "doc_id", vector: str = "tsv", counts: str = "freqs") -> DataFrame:
    """(key, word, tf, length): what each record uses of each lower-case word, and its total of uses.

    The number of positions in ``vector`` counts; where ``vector`` is null, the ``nentry`` sums of
    ``counts``. Both null, an empty list, null words and uses of zero or less give no row; null
    ``nentry`` counts as zero. Words that differ only in letter case are added up. All other columns
    of the input are ignored, whatever their names.
    """
    records = _records(documents, key, vector, counts)
    return records.select(key, "length", F.explode("_uses").alias("word", "tf")).select(key, "word", "tf", "length")


def distinctive_terms(documents: DataFrame, key: str = "doc_id", vector: str = "tsv", counts: str = "freqs", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, word, tf, df, length, score): BM25 weight of each word of each record.

    score = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length), with the
    Robertson/Sparck Jones idf ln(1 + (N - df + 0.5) / (df + 0.5)). N counts all records, those
    without words too; the average length is over records that have words. Document frequencies come
    from all records by a partial aggregation (one row per word and task is shuffled); a caller's
    filters on ``tf`` and ``df`` are pushed below the join, so only the surviving postings move.
    Repeated rows count as often as they stand in the table. An empty table gives no rows.
    """
    terms = record_terms(documents, key, vector, counts)
    frequency = terms.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = documents.select(_length(_terms(vector, counts)).alias("length")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("length") > 0, F.col("length"))).alias("mean"))
    n, mean = total.select("n").scalar(), total.select("mean").scalar()
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1 - F.lit(b) + F.lit(b) * F.col("length") / mean
    return terms.join(frequency, "word").select(
        key, "word", "tf", "df", "length", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)).alias("score")
    )


def found(documents: DataFrame, least_tf: int = 3, least_df: int = 2, most_df: int = 8) -> DataFrame:
    """(doc_id, word): the scored words that a record uses at least ``least_tf`` times and few records use at all.

    The rule asks for frequencies only; ``distinctive_terms`` has the weights (query p1_scores).
    """
    scored = distinctive_terms(documents).where(F.col("tf") >= least_tf).where(F.col("df").between(least_df, most_df))
    return scored.select("doc_id", "word").distinct()
