"""Full-text vectors, statistics, and the query language."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# English stop words of the text search configuration.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
TOKEN = r"[\p{L}\p{N}]+"
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def to_vector(text: Column, weight: str = "D", stem: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<word,pos,weight>>: stop words drop out but keep their place numbers; words are stemmed if asked."""
    words = F.transform(tokens(text), lambda w, i: F.struct((stem(w) if stem else w).alias("word"), (i + 1).alias("pos"), F.lit(weight).alias("weight"), w.alias("raw")))
    kept = F.filter(words, lambda e: ~e["raw"].isin(*STOP_WORDS))
    return F.transform(kept, lambda e: F.struct(e["word"].alias("word"), e["pos"].cast("int").alias("pos"), e["weight"].alias("weight")))


def concat_vectors(left: Column, right: Column) -> Column:
    """The right side's places follow on the left side's largest."""
    shift = F.coalesce(F.array_max(F.transform(left, lambda e: e["pos"])), F.lit(0))
    return F.concat(left, F.transform(right, lambda e: F.struct(e["word"].alias("word"), (e["pos"] + shift).cast("int").alias("pos"), e["weight"].alias("weight"))))


def document_vector(title: Column, keywords: Column, abstract: Column, stem: Callable[[Column], Column] | None = None) -> Column:
    """Title weighted A, keywords B, abstract C."""
    parts = [to_vector(c, w, stem) for c, w in ((title, "A"), (keywords, "B"), (abstract, "C"))]
    return concat_vectors(concat_vectors(parts[0], parts[1]), parts[2])


def vector_map(vector: Column) -> Column:
    """map<word, array<struct<pos,weight>>> of an array vector."""
    words = F.array_distinct(F.transform(vector, lambda e: e["word"]))
    return F.map_from_arrays(
        words,
        F.transform(words, lambda w: F.transform(F.filter(vector, lambda e: e["word"] == w), lambda e: F.struct(e["pos"].alias("pos"), e["weight"].alias("weight")))),
    )


def word_counts(words: DataFrame, key: str, word: str) -> DataFrame:
    """(key, words): array<struct<word,nentry>> per record, most frequent first, then by word."""
    counts = words.groupBy(key, word).agg(F.count(F.lit(1)).cast("int").alias("nentry"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("nentry")).alias("n"), F.col(word).alias("word"))))
    return counts.groupBy(key).agg(F.transform(ordered, lambda e: F.struct(e["word"].alias("word"), (-e["n"]).cast("int").alias("nentry"))).alias("words"))


#: Languages whose words are stemmed.
STEMMED = ("english", "en", "eng", "en_xx")
_WORD = re.compile(r"[^\W_]+")
_STOP = frozenset(STOP_WORDS)


def vector_of(fields: tuple[str | None, ...], stem: Callable[[str], str] | None = None, weights: str = "ABC") -> dict[str, list[tuple[int, str]]]:
    """Word to its (place, weight): the fields one behind the other, stop words out but counted; words in order."""
    found: dict[str, list[tuple[int, str]]] = {}
    last = 0
    for field, weight in zip(fields, weights):
        end = last
        for at, w in enumerate(_WORD.findall(field.lower()) if field else (), last + 1):
            if w not in _STOP:
                found.setdefault(stem(w) if stem else w, []).append((at, weight))
                end = at
        last = end
    return dict(sorted(found.items()))


def build_vectors(documents: DataFrame, key: str = "doc_id", language: Column | None = None) -> DataFrame:
    """(key, tsv, freqs) of title (A), keywords (B) and abstract (C).

    Without ``language`` words are kept as they are; with it the words of the languages in STEMMED are
    stemmed, each distinct word of a batch once. Null fields add nothing. ``freqs`` counts the words of
    ``tsv``, most frequent first, then by word. One pass over each row in batches, nothing is shuffled.
    """

    @F.pandas_udf("array<struct<word:string,places:array<struct<pos:int,weight:string>>>>")
    def vectors(title: pd.Series, keywords: pd.Series, abstract: pd.Series, stemmed: pd.Series) -> pd.Series:
        stem = lru_cache(maxsize=None)(porter)
        rows = (vector_of((t, k, a), stem if s else None) for t, k, a, s in zip(title, keywords, abstract, stemmed))
        return pd.Series([[{"word": w, "places": [{"pos": p, "weight": x} for p, x in ps]} for w, ps in v.items()] for v in rows])

    stemmed = F.lit(False) if language is None else F.coalesce(F.lower(F.trim(language)).isin(*STEMMED), F.lit(False))
    built = documents.select(F.col(key), vectors("title", "keywords", "abstract", stemmed).alias("_v"))
    counts = F.array_sort(F.transform("_v", lambda e: F.struct((-F.size(e["places"])).alias("n"), e["word"].alias("word"))))
    return built.select(key, F.map_from_entries("_v").alias("tsv"), F.transform(counts, lambda e: F.struct(e["word"].alias("word"), (-e["n"]).alias("nentry"))).alias("freqs"))


def matches_in(query: str | None, vector: Column, language: Column) -> Column:
    """As ``matches``, the query's words stemmed where the document's language is."""
    stemmed = F.coalesce(F.lower(F.trim(language)).isin(*STEMMED), F.lit(False))
    return F.when(stemmed, matches(query, vector, porter)).otherwise(matches(query, vector))


def folded_vectors(documents: DataFrame, group: str, order: str, vector: str = "tsv") -> DataFrame:
    """(group, tsv): the vectors of a group's rows one behind the other in ``order``; places follow on the largest before them.

    Only the largest place of each row is gathered in order; the words stay spread.
    """
    last = documents.select(group, order, F.coalesce(F.array_max(F.flatten(F.transform(F.map_values(vector), lambda ps: F.transform(ps, lambda p: p["pos"])))), F.lit(0)).cast("long").alias("_n"))
    before = last.withColumn("_shift", F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    long = documents.select(group, order, F.explode(vector).alias("word", "places")).join(before, [group, order])
    moved = long.select(group, "word", F.explode(F.transform("places", lambda p: F.struct((p["pos"] + F.col("_shift")).alias("pos"), p["weight"].alias("weight")))).alias("p"))
    words = moved.groupBy(group, "word").agg(F.array_sort(F.collect_list("p")).alias("places"))
    return words.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias(vector))


def stored_counts(text: Column) -> Column:
    """array<struct<word,nentry>> of a stored JSON list; text that is no list gives null."""
    return F.from_json(text, "array<struct<word:string,nentry:int>>")


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of the words, each word with two blanks before and one behind."""
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    pieces = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_sort(F.array_distinct(F.flatten(pieces)))


def postings(documents: DataFrame, key: str = "doc_id", vector: str = "tsv") -> DataFrame:
    """(key, word, positions): the long form of a vector column."""
    return documents.select(key, F.explode(vector).alias("word", "positions"))


def term_statistics(documents: DataFrame, key: str = "doc_id", vector: str = "tsv") -> DataFrame:
    """(word, ndoc, nentry) over a collection; a record has a word once in its vector, so documents are plain counts."""
    return postings(documents, key, vector).groupBy("word").agg(F.count(F.lit(1)).alias("ndoc"), F.sum(F.size("positions")).cast("long").alias("nentry"))


def pruned_vocabulary(statistics: DataFrame, ndoc: tuple[float, float] = (0, float("inf")), nentry: tuple[float, float] = (0, float("inf"))) -> DataFrame:
    """Words strictly between all four bounds."""
    return statistics.where((F.col("ndoc") > ndoc[0]) & (F.col("ndoc") < ndoc[1]) & (F.col("nentry") > nentry[0]) & (F.col("nentry") < nentry[1]))


def build_query(user_text: str | None, operator: str = "or") -> str | None:
    """User text to a query string: phrases first (from the right), then words; a leading - negates."""
    if not user_text or not user_text.strip():
        return None
    op = "&" if operator == "and" else "|"
    phrases = [f"({' <-> '.join(p.split())})" for p in re.findall(r'"([^"]*)"', user_text) if p.split()][::-1]
    rest = re.sub(r'"[^"]*"', " ", user_text).replace('"', " ").split()
    words = ["!" + w[1:] if w.startswith("-") else w for w in rest if w.strip("-")]
    return op.join(phrases + words) or None


def _parse(query: str):
    parts = re.findall(r"<->|[()&|!]|[^\s()&|!<]+", query)
    at = 0

    def peek() -> str | None:
        return parts[at] if at < len(parts) else None

    def take() -> str:
        nonlocal at
        at += 1
        return parts[at - 1]

    def binary(level: int):
        ops = ("|", "&", "<->")
        if level == 3:
            return unary()
        node = binary(level + 1)
        while peek() == ops[level]:
            take()
            node = (ops[level], node, binary(level + 1))
        return node

    def unary():
        p = peek()
        if p == "!":
            take()
            return ("!", unary())
        if p == "(":
            take()
            node = binary(0)
            if peek() == ")":
                take()
            return node
        if p is None:
            raise ValueError(f"query ends too early: {query}")
        return ("word", take().lower())

    tree = binary(0)
    if at < len(parts):
        raise ValueError(f"cannot read {parts[at]!r} in {query}")
    return tree


def matches(query: str | None, vector: Column, word_form: Callable[[str], str] | None = None) -> Column:
    """Predicate of a query string on a vector map column; a null vector matches nothing, no query everything."""
    if query is None:
        return F.lit(True)
    form = word_form or (lambda w: w)

    def ends(node) -> Column:
        """Places at which a phrase operand ends."""
        if node[0] == "word":
            here = F.transform(F.try_element_at(vector, F.lit(form(node[1]))), lambda e: e["pos"])
            return F.coalesce(here, F.array().cast("array<int>"))
        if node[0] == "<->":
            before = ends(node[1])
            return F.filter(ends(node[2]), lambda p: F.array_contains(before, p - 1))
        raise ValueError("only words can follow each other")

    def build(node) -> Column:
        if node[0] == "word":
            return F.map_contains_key(vector, F.lit(form(node[1])))
        if node[0] == "!":
            return ~build(node[1])
        if node[0] == "<->":
            return F.size(ends(node)) > 0
        a, b = build(node[1]), build(node[2])
        return a & b if node[0] == "&" else a | b

    return F.coalesce(build(_parse(query)), F.lit(False))


def _measure(stem: str) -> int:
    kinds = "".join("v" if c in "aeiou" or c == "y" and i and stem[i - 1] not in "aeiou" else "c" for i, c in enumerate(stem))
    return len(re.findall("v+c+", kinds))


def porter(word: str) -> str:
    """Stem of the suffix-stripping algorithm published by M. F. Porter in 1980."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    vowel = lambda s: any(c in "aeiou" or c == "y" and i and s[i - 1] not in "aeiou" for i, c in enumerate(s))
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and s[-1] not in "aeiouy"

    def cvc(s: str) -> bool:
        return len(s) > 2 and s[-1] not in "aeiouwxy" and (s[-2] in "aeiou" or s[-2] == "y") and s[-3] not in "aeiou"

    w = word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    steps = (
        (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")),
        (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")),
    )
    for step in steps:
        for end, new in step:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    if double(w) and w[-1] == "l" and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(words: Column) -> Column:
    """Stems of an array of words, each distinct word of a batch stemmed once."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return pd.Series([None if ws is None else [known.setdefault(w, porter(w)) if w not in known else known[w] for w in ws] for ws in batch])

    return run(words)
