"""Several values packed in one field: choose each field's dialect by description length, then split."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.plans.lineage import cut

#: Delimiters by name. A slash counts only between blanks, a word only between blanks.
DELIMITERS = {
    ";": r";", "|": r"\|", "\n": r"[\r\n]+", "\t": r"\t", "·": r"·", "•": r"•", "/": r"(?<!\S)/(?!\S)", ",": r",", "and": r"(?<=\s)and(?=\s)", "&": r"(?<=\s)&(?=\s)",
}
#: Delimiters that no single value contains; fields with one of them and no other delimiter seed the code lengths.
STRONG = frozenset(";|\n\t·•/")
FIELDS = {
    "keywords": (";", "|", "\n", "\t", "·", "•", "/", ","),
    "authors": (";", "|", "\n", "\t", "·", "•", "/", ",", "and", "&"),
}
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»"}
_ANY_STRONG = re.compile("|".join(DELIMITERS[d] for d in sorted(STRONG)))
_TOKEN = re.compile(r"[^\W_]+|,")


def split_values(text: str, delimiters: tuple[str, ...]) -> list[tuple[str, bool]]:
    """(value, was it quoted) of one dialect: quotes are respected where they enclose a whole value.

    Empty values are dropped. White space around values and the enclosing quotes are removed.
    """
    if not delimiters:
        parts = [text]
    else:
        rule = re.compile("|".join(DELIMITERS[d] for d in delimiters))
        parts, start, at = [], 0, 0
        while True:
            lead = re.compile(r"\s*").match(text, start).end()
            at = start
            if lead < len(text) and text[lead] in QUOTES:  # a quoted value ends at a quote before a delimiter or the end
                close, end = QUOTES[text[lead]], lead + 1
                while (end := text.find(close, end)) >= 0:
                    rest = re.compile(r"\s*").match(text, end + 1).end()
                    if rest == len(text) or rule.match(text, rest) or rule.match(text, end + 1) or "\n" in text[end + 1 : rest] and "\n" in delimiters or "\t" in text[end + 1 : rest] and "\t" in delimiters:
                        at = end + 1
                        break
                    end += 1
            m = rule.search(text, at)
            if not m:
                parts.append(text[start:])
                break
            parts.append(text[start : m.start()])
            start = m.end()
    out = []
    for p in parts:
        p = p.strip()
        quoted = len(p) >= 2 and p[0] in QUOTES and p[-1] == QUOTES[p[0]]
        if quoted:
            p = p[1:-1].strip()
        if p and any(c.isalnum() for c in p):
            out.append((p, quoted))
    return out


def shape_of(value: str, quoted: bool) -> str:
    """The kind of each word of a value: initials, short words, words, commas. Quoted values have one shape."""
    if quoted:
        return '"'
    kinds = []
    for t in _TOKEN.findall(value):
        kinds.append("," if t == "," else t.lower() if t.lower() in ("and", "phd") else "I" if len(t) == 1 else "i" if len(t) == 2 else "W")
    return "".join(k if len(k) == 1 else f"<{k}>" for k in kinds)


def dialects_of(text: str, allowed: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Every set of allowed delimiters that occur in the text, the empty set first."""
    seen = [d for d in allowed if re.search(DELIMITERS[d], text)]
    return [c for n in range(len(seen) + 1) for c in combinations(seen, n)]


def _parses(text: str, allowed: tuple[str, ...]) -> tuple[list[list[tuple[str, bool]]], int]:
    """The different parses of a field, fewest delimiters first, and the place of the seed parse (or -1)."""
    options = dialects_of(text, allowed)
    one_strong = sum(d in STRONG for d in options[-1]) == 1
    parsed, seed = [], -1
    for option in options:
        values = split_values(text, option)
        if values and values not in parsed:
            if one_strong and len(values) > 1 and len(option) == 1 and option[0] in STRONG:
                seed = len(parsed)
            parsed.append(values)
    return parsed, seed


def _seeds(rows: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for field, text in zip(batch["field"], batch["text"]):
                parsed, seed = _parses(text, fields[field])
                if seed >= 0:
                    out += [(field, v.casefold(), shape_of(v, q)) for v, q in parsed[seed]]
            yield pd.DataFrame(out, columns=["field", "code", "shape"])

    return rows.select("field", "text").mapInPandas(run, "field string, code string, shape string")


def _candidates(rows: DataFrame, kind: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    columns = ["_key", "field", "dialect", "pos", "val", "code", "shape", "own_code", "own_shape", "escapes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, field, text in zip(batch["_key"], batch["field"], batch["text"]):
                parsed, seed = _parses(text, fields[field])
                own = parsed[seed] if seed >= 0 else []
                codes = Counter(v.casefold() for v, _ in own)
                shapes = Counter(shape_of(v, q) for v, q in own)
                for dialect, values in enumerate(parsed):
                    for pos, (value, quoted) in enumerate(values, 1):
                        code, shape = value.casefold(), shape_of(value, quoted)
                        escapes = 0 if quoted else len(_ANY_STRONG.findall(value))
                        out.append((key, field, dialect, pos, value, code, shape, codes[code], shapes[shape], escapes))
            yield pd.DataFrame(out, columns=columns)

    schema = f"_key {kind}, field string, dialect int, pos int, val string, code string, shape string, own_code int, own_shape int, escapes int"
    return rows.mapInPandas(run, schema)


def unpack_values(df: DataFrame, key: str = "doc_id", fields: dict[str, tuple[str, ...]] | None = None, letter_bits: float = 4.5, stop_bits: float = 2.0, strong_bits: float = 20.0) -> DataFrame:
    """(key, field, pos, val): one row per value of every packed field, with its place in the list.

    A dialect is a set of delimiters (with quotes respected); each field is parsed by every dialect
    whose delimiters it contains. The description length of a parse is the sum of its values' code
    lengths: a value that the collection knows costs -log2 of its share of all known values, any other
    the bits of its shape plus ``letter_bits`` a letter; every value also costs ``stop_bits``, and ``strong_bits`` for each strong delimiter left inside it. Shares
    of values and shapes are counted over the whole collection, from the fields that have exactly one
    strong delimiter kind (a field's own values are taken off). The cheapest parse wins; ties go to
    fewer delimiters.

    Null and blank fields and fields without a letter or digit give no row; a field of one value gives
    that value. Very long fields are parsed whole. Equal keys are kept apart only if the key is unique;
    repeated rows with one key are taken as one. Extra columns are ignored.
    """
    fields = fields or FIELDS
    kind = dict(df.dtypes)[key]
    arms = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    rows = df.select(F.col(key).alias("_key"), arms.alias("f")).select("_key", "f.field", "f.text").where(r"text RLIKE '[^\\s]'")
    parses = _candidates(rows, kind, fields)

    seeds = cut(_seeds(rows, fields).groupBy("field", "code", "shape").agg(F.count(F.lit(1)).alias("n")))
    known = seeds.groupBy("field", "code").agg(F.sum("n").alias("n_code"))
    shapes = seeds.groupBy("field", "shape").agg(F.sum("n").alias("n_shape"))
    totals = {r["field"]: r["n"] for r in seeds.groupBy("field").agg(F.sum("n").alias("n")).collect()}  # one row a field name
    total = F.lit(1.0)
    for f, n in totals.items():
        total = F.when(F.col("field") == f, F.lit(float(n))).otherwise(total)

    scored = parses.join(known, ["field", "code"], "left").join(shapes, ["field", "shape"], "left")
    share = F.greatest(F.coalesce("n_code", F.lit(0)) - F.col("own_code"), F.lit(0)) / (total + 1)
    form = (F.greatest(F.coalesce("n_shape", F.lit(0)) - F.col("own_shape"), F.lit(0)) + 0.02) / (total + 1)
    # the mixture of both codes in logarithms, so that no length is too long for it
    known_bits = F.when(share > 0, F.log2(0.5 * share))
    spelled_bits = F.log2(0.5 * form) - F.length("val") * letter_bits
    top = F.greatest(known_bits, spelled_bits)
    bits = -(top + F.log2(1 + F.coalesce(F.pow(F.lit(2.0), F.least(known_bits, spelled_bits) - top), F.lit(0.0)) * F.when(share > 0, 1.0).otherwise(0.0)))
    per_parse = scored.groupBy("_key", "field", "dialect").agg(
        F.sum(bits + stop_bits + F.col("escapes") * strong_bits).alias("bits"), F.collect_set(F.struct("pos", "val")).alias("values")
    )
    best = per_parse.groupBy("_key", "field").agg(F.min_by("values", F.struct(F.round("bits", 6), "dialect")).alias("values"))
    return best.select(F.col("_key").alias(key), "field", F.explode("values").alias("v")).select(key, "field", "v.pos", "v.val")


def lists_only(values: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of fields that list at least two values."""
    many = values.groupBy(key, "field").agg(F.max("pos").alias("n")).where("n >= 2").drop("n")
    return values.join(many, [key, "field"], "left_semi")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, field, pos, val) of the keyword and author lists of at least two values."""
    return lists_only(unpack_values(documents)).select("doc_id", "field", F.col("pos").cast("long").alias("pos"), "val")
