"""Works from dirty records, and for each work the surviving record and the fused values."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholarium.functions.visible import letters_only
from scholarium.operators.components import connected_components
from scholarium.plans.lineage import cut

FIELDS = ("doi", "title", "abstract", "keywords")
#: What people type where a value is missing, in letters and digits only.
STAND_INS = ("", "0", "na", "nil", "none", "null", "nan", "unknown", "tba", "tbd", "pending", "missing", "untitled", "notitle", "titlenotavailable", "notitleavailable", "titlemissing", "titleunknown", "abstractmissing", "abstractnotavailable", "noabstract", "noabstractavailable", "nokeywords", "nokeywordsavailable", "keywordsmissing", "keywordsnotavailable", "notavailable", "notapplicable", "notstated", "tobeassigned", "tobeannounced", "authornotstated", "anonymous", "unknownauthor", "etal")
#: Labels that stand before a value.
LABELS = r"(?i)^\s*(abstract|summary|resumen|resumo|zusammenfassung|keywords?|key words|index terms|palabras clave|palavras-chave|schlagwörter|title|título|titel)\s*[.:–—-]+\s*"
#: Remarks that stand after a value that was cut short.
CUT_MARKS = r"(?i)\s*[(\[]\s*(truncated|cut|shortened|abridged|continued|more|\.\.\.|…)\s*[)\]]\s*$"
LEAST_CUT = 24  #: letters that a cut-short value keeps at least; a shorter one is compared as it stands
TELLING = 60  #: letters from which an abstract alone tells a work
MISSING_SOURCE = "(none)"
MOST_SOURCES = 200  #: more sources are refused: their dependence is a square matrix on the driver


def doi_form(doi: Column) -> Column:
    """A real DOI in one spelling, else null: prefixes, blanks and a closing full stop do not matter."""
    low = F.regexp_replace(F.lower(doi), r"\s+", "")
    found = F.regexp_extract(low, r"(10\.[0-9]{4,9}/[^\s]*[\p{L}\p{N}])", 1)
    return F.when(found != "", found)


def value_form(value: Column) -> Column:
    """Letters and digits without leading label, cut mark and stand-ins, & read as and; null if nothing usable is left."""
    form = letters_only(F.replace(F.regexp_replace(F.regexp_replace(value, LABELS, ""), CUT_MARKS, ""), F.lit("&"), F.lit("and")))
    return F.when(~form.isin(*STAND_INS) & ~form.rlike("^microsoftword.*docx?$"), form)


def _forms(documents: DataFrame) -> DataFrame:
    year = F.when(F.col("publication_date").between(1500, 2100), F.col("publication_date"))
    return documents.where("doc_id IS NOT NULL").select(
        "doc_id", doi_form(F.col("doi")).alias("doi_form"),
        *[value_form(F.col(c)).alias(f"{c}_form") for c in FIELDS[1:]],
        value_form(F.regexp_replace(F.lower("authors"), r"(^|\s)and(?=\s)", " ")).alias("authors_form"),
        value_form(F.col("container")).alias("container_form"), year.alias("year"),
    )


def _evidence(rows: DataFrame) -> DataFrame:
    """(doc_id, doi_form, block, form): what two records of one work share; a record has up to eight.

    ``block`` is a print of fields that must be equal, ``form`` the whole of a field that one of them may hold cut short ('' if there is none).
    """
    t, a, k = F.col("title_form"), F.col("abstract_form"), F.col("keywords_form")
    who, where, year = F.col("authors_form"), F.col("container_form"), F.col("year").cast("string")
    long_t, long_a = F.when(F.length(t) >= LEAST_CUT, t), F.when(F.length(a) >= LEAST_CUT, a)
    nothing = F.lit("")
    kinds = [
        ((who,), long_t), ((where, year), long_t), ((k,), long_t), ((t, who, where, year), nothing),
        ((), F.when(F.length(a) >= TELLING, a)), ((who,), long_a), ((where, year), long_a), ((who, where, year, k), nothing),
    ]
    parts = []
    for n, (equal, form) in enumerate(kinds):
        known = form.isNotNull()
        for p in equal:
            known = known & p.isNotNull() & (F.length(p) > 0)
        parts.append(F.when(known, F.struct(F.xxhash64(F.lit(n), *equal).alias("block"), form.alias("form"))))
    return rows.select("doc_id", "doi_form", F.explode(F.array_compact(F.array(*parts))).alias("e")).select("doc_id", "doi_form", "e.*")


def _whole_forms(forms: DataFrame) -> DataFrame:
    """(key, whole) of the cut-short forms of (head, block, form): ``whole`` is the key of the longest form of the block that starts with it.

    A form that starts two forms that go on differently is cut from one of them, nobody knows which, and
    has no row. Forms arrive in order, a form before those that start with it, so one pass with the
    chain of beginnings is enough and nothing is gathered.
    """
    ordered = forms.repartition("head").sortWithinPartitions("head", "block", "form").select("block", "form", F.xxhash64("block", "form").alias("key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain: list[list] = []  # [block, form, key, keys of the whole forms above it, how many go on from it]
        out: list[tuple[int, int]] = []

        def leave() -> None:
            _, _, key, whole, on = chain.pop()
            whole = whole if on else key
            if on and whole is not None:
                out.append((key, whole))
            if chain:
                chain[-1][4] += 1
                chain[-1][3] = whole if chain[-1][4] == 1 else None

        for batch in batches:
            for block, form, key in zip(batch["block"], batch["form"], batch["key"]):
                while chain and not (chain[-1][0] == block and form.startswith(chain[-1][1])):
                    leave()
                chain.append([block, form, key, None, 0])
            yield pd.DataFrame(out, columns=["key", "whole"])
            out.clear()
        while chain:
            leave()
        yield pd.DataFrame(out, columns=["key", "whole"])

    return ordered.mapInPandas(run, "key long, whole long")


def _keys(rows: DataFrame) -> DataFrame:
    """(doc_id, doi_form, key): the evidence that two records share, a cut-short form under the key of its whole."""
    evidence = _evidence(rows).withColumn("key", F.xxhash64("block", "form"))
    keys = cut(evidence.select("doc_id", "doi_form", "key"))
    begun = evidence.where("form <> ''").withColumn("head", F.xxhash64("block", F.substring("form", 1, LEAST_CUT)))
    several = begun.groupBy("head").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("head")
    forms = begun.join(several, "head", "left_semi").select("head", "block", "form").distinct()
    whole = _whole_forms(forms)
    return keys.join(whole, "key", "left").select("doc_id", "doi_form", F.coalesce("whole", "key").alias("key"))


def works(documents: DataFrame) -> DataFrame:
    """(doc_id, work): records of one work share ``work``.

    Records with the same real DOI are one work, with different ones never. A record without a DOI
    joins a DOI through shared evidence (title and authors, title and place, the abstract, a short
    title with authors, place and year, and the like; a value cut short counts as the one whole value
    that it begins) that belongs to exactly one DOI; where
    different evidence names different DOIs, the most often named wins, then the smaller. That is
    repeated until no record is added, so that evidence passes on; records still without a DOI form components
    over the evidence that no DOI has. All steps are aggregations by evidence, so no pairs of a large
    group are formed.
    """
    rows = cut(_keys(_forms(documents)))
    open_rows = rows.where("doi_form IS NULL").select("doc_id", "key")
    named = rows.where("doi_form IS NOT NULL").select("key", "doi_form")
    given = None
    for step in count(1):
        owner = named.groupBy("key").agg(F.min("doi_form").alias("d"), F.max("doi_form").alias("e")).where("d = e").select("key", "d")
        votes = open_rows.join(owner, "key").groupBy("doc_id", "d").agg(F.count(F.lit(1)).alias("n"))
        new = cut(votes.groupBy("doc_id").agg(F.min_by("d", F.struct(-F.col("n"), F.col("d"))).alias("doi_form")))
        given = new if given is None else given.union(new)
        if new.isEmpty():
            break
        named = named.union(open_rows.join(new, "doc_id").select("key", "doi_form"))
        open_rows = open_rows.join(new, "doc_id", "left_anti")
        if step % 3 == 0:  # long chains only: plans must not grow with the rounds
            named, open_rows, given = cut(named), cut(open_rows), cut(given)
    free = open_rows.join(named.select("key").distinct(), "key", "left_anti")
    first = free.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = connected_components(free.join(first, "key").select("doc_id", "first"), "doc_id", "first")
    base = documents.where("doc_id IS NOT NULL").select("doc_id", doi_form(F.col("doi")).alias("own"))
    base = base.join(given, "doc_id", "left").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    work = F.coalesce("own", "doi_form", F.concat(F.lit("r"), F.coalesce("component", "doc_id").cast("string")))
    return base.select("doc_id", work.alias("work")).dropDuplicates(["doc_id"])


def _dependence(pairs: list, accuracy: dict[str, float], copied: float = 0.8, false_values: int = 10, prior: float = 0.2) -> dict[tuple[str, str], float]:
    """Chance that two sources depend on each other, from the counts of shared true, shared false and different values."""
    out = {}
    for s, t, same_true, same_false, different in pairs:
        a, b = accuracy[s], accuracy[t]
        true, false = a * b, (1 - a) * (1 - b) / false_values
        rest = max(1e-9, 1 - true - false)
        mean = (a + b) / 2
        alone = same_true * math.log(true) + same_false * math.log(false) + different * math.log(rest)
        copying = (
            same_true * math.log(mean * copied + true * (1 - copied))
            + same_false * math.log((1 - mean) * copied + false * (1 - copied))
            + different * math.log(rest * (1 - copied))
        )
        gap = max(-500.0, min(500.0, alone - copying))
        out[s, t] = 1 / (1 + (1 - prior) / prior * math.exp(gap))
    return out


def _votes(providers: Column, order: list[str], accuracy: dict[str, float], depends: dict[tuple[str, str], float], false_values: int, copied: float) -> Column:
    """Sum of the votes of the sources of one value; a source counts less for each better source of the same value that it may have copied from."""
    at = {s: i for i, s in enumerate(order)}
    weight = np.array([math.log(false_values * accuracy[s] / (1 - accuracy[s])) for s in order])
    own = np.array([[1 - copied * depends.get((min(s, t), max(s, t)), 0.0) for t in order] for s in order])

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for names in values:
            names = tuple(names)
            if names not in known:
                places = sorted(at[n] for n in names)
                known[names] = float(sum(weight[p] * own[p, places[:i]].prod() for i, p in enumerate(places)))
            out.append(known[names])
        return pd.Series(out, dtype="float64")

    return run(providers)


def fused_values(claims: DataFrame, rounds: int = 2, false_values: int = 10, copied: float = 0.8, prior: float = 0.2) -> DataFrame:
    """(work, field, form, posterior) of every claimed value of (work, field, form, source).

    Each round: a value's score is the sum of its sources' votes, ln(false_values * accuracy / (1 -
    accuracy)), where a source that may have copied from a better source of the *same* value is
    discounted by ``copied`` times the chance of their dependence; the posterior is the softmax of the scores over the
    values of one field of one work. A source's accuracy is the mean posterior of its values (kept in
    0.05 .. 0.99), and dependence is estimated from the values that two sources share: shared false ones speak for it.
    ``false_values`` is the number of false values that a field may take, ``prior`` the chance of dependence before anything is seen.

    Sources are few (how records came in): one row a source and one a pair of sources reach the driver,
    and more than MOST_SOURCES are refused. Nothing else grows with the number of records of a work: a
    value is one row, whatever the number of its records, and pairs of sources are counted, not formed by record.
    """
    sources = sorted(r[0] for r in claims.select("source").distinct().limit(MOST_SOURCES + 1).collect())
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    values = cut(claims.groupBy("work", "field", "form").agg(F.sort_array(F.collect_set("source")).alias("providers")))
    shared = lambda rows: {(r[0], r[1]): r[2] for r in rows.select(F.explode("providers").alias("s"), "providers").select("s", F.explode("providers").alias("t")).where("s < t").groupBy("s", "t").agg(F.count(F.lit(1))).collect()}
    many = values.select("work", "field", F.explode("providers").alias("source")).groupBy("work", "field", "source").agg(F.count(F.lit(1)).alias("n"))
    many = many.groupBy("work", "field").agg(F.collect_list(F.struct("source", "n")).alias("all"))  # one entry a source
    pairs = many.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a.source < b.source")
    together = {(r[0], r[1]): r[2] for r in pairs.groupBy("a.source", "b.source").agg(F.sum(F.col("a.n") * F.col("b.n"))).collect()}
    equal = shared(values)
    accuracy, depends = {s: 0.8 for s in sources}, {}
    for turn in range(rounds + 1):
        order = sorted(sources, key=lambda s: (-accuracy[s], s))
        score = values.withColumn("score", _votes(F.col("providers"), order, accuracy, depends, false_values, copied))
        of_item = W.partitionBy("work", "field")  # distinct values of one work, few even where its records are many
        share = F.exp(F.col("score") - F.max("score").over(of_item))
        score = score.withColumn("share", share).withColumn("posterior", F.col("share") / F.sum("share").over(of_item)).drop("score", "share")
        if turn == rounds or not sources:
            return score.drop("providers")
        score = cut(score)
        got = score.select(F.explode("providers").alias("source"), "posterior").groupBy("source").agg(F.avg("posterior")).collect()
        accuracy = {r[0]: min(0.99, max(0.05, r[1])) for r in got}
        true = shared(score.where("posterior > 0.5"))
        seen = [(s, t, true.get((s, t), 0), equal.get((s, t), 0) - true.get((s, t), 0), n - equal.get((s, t), 0)) for (s, t), n in together.items()]
        depends = _dependence(seen, accuracy, copied, false_values, prior)
    raise AssertionError


def best_records(documents: DataFrame, trust: DataFrame, rounds: int = 2, false_values: int = 10) -> DataFrame:
    """(work, first_doc_id, best_doc_id, n_records, doi, title, abstract, keywords), one row per work of two records or more.

    ``best_doc_id`` is the record with the most usable values; ties go to the higher trust of its
    source, the later added_at, then the smaller id. A value is usable unless it is null, blank, a
    stand-in, or the beginning of a longer value of the same work. The other columns are fused field
    by field: source accuracies and dependence between sources (from shared false values) are estimated
    over all works, votes of dependent sources are discounted, and the value of the largest posterior
    wins (ties: the longer, then the smaller), in the stored spelling of its most trusted record.

    A null source has trust 0, as has a source without a row in ``trust``. Exact copies of a record
    count once as a claim of their source; rows that repeat an id are one record. Null ids are ignored; an empty table gives no rows.
    """
    grouped = works(documents)
    many = grouped.groupBy("work").agg(F.count(F.lit(1)).alias("n_records"), F.min("doc_id").alias("first_doc_id")).where("n_records > 1")
    ranks = trust.groupBy("source").agg(F.max("trust").alias("trust"))
    rows = documents.select("doc_id", *FIELDS, "source", "added_at").join(grouped, "doc_id").dropDuplicates(["doc_id"]).join(many.select("work"), "work", "left_semi")
    rows = rows.join(ranks, "source", "left").withColumn("trust", F.coalesce("trust", F.lit(0))).withColumn("source", F.coalesce("source", F.lit(MISSING_SOURCE)))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("raw"), (doi_form(F.col(c)) if c == "doi" else value_form(F.col(c))).alias("form")) for c in FIELDS]))
    long = cut(rows.select("work", "doc_id", "source", "trust", "added_at", cells.alias("c")).select("work", "doc_id", "source", "trust", "added_at", "c.*"))

    claims = long.where("form IS NOT NULL").groupBy("work", "field", "form", "source").agg(
        F.max_by("raw", F.struct("trust", F.coalesce("added_at", F.lit("0001-01-01").cast("timestamp_ntz")).cast("string"), "raw")).alias("raw"), F.max("trust").alias("trust")
    )
    claims = cut(claims)
    distinct = claims.select("work", "field", "form").distinct()
    after = F.lead("form").over(W.partitionBy("work", "field").orderBy("form"))  # a longer form that starts alike follows at once
    short = distinct.withColumn("short", F.coalesce((F.col("field") != "doi") & F.startswith(after, F.col("form")), F.lit(False))).where("short").drop("short")
    usable = long.where("form IS NOT NULL").join(short, ["work", "field", "form"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("usable"))
    scored = long.where("field = 'doi'").join(usable, "doc_id", "left")
    order = F.struct(F.coalesce("usable", F.lit(0)).alias("u"), F.col("trust").alias("t"), F.col("added_at").alias("d"), (-F.col("doc_id")).alias("i"))
    best = scored.groupBy("work").agg(F.max_by("doc_id", order).alias("best_doc_id"))

    posterior = fused_values(claims.select("work", "field", "form", "source"), rounds, false_values)
    posterior = posterior.join(short.withColumn("short", F.lit(1)), ["work", "field", "form"], "left")
    top = posterior.groupBy("work", "field").agg(
        F.min_by("form", F.struct(F.coalesce("short", F.lit(0)).alias("s"), (-F.round("posterior", 9)).alias("p"), (-F.length("form")).alias("l"), F.col("form").alias("f"))).alias("form")
    )
    spelled = claims.groupBy("work", "field", "form").agg(F.max_by("raw", F.struct("trust", "raw")).alias("raw"))
    fused = top.join(spelled, ["work", "field", "form"]).groupBy("work").pivot("field", list(FIELDS)).agg(F.first("raw"))
    return many.join(best, "work").join(fused, "work", "left").select("work", "first_doc_id", "best_doc_id", "n_records", *FIELDS)


def found(documents: DataFrame, trust: DataFrame) -> DataFrame:
    """(first_doc_id, best_doc_id), one row per work that at least two records describe."""
    return best_records(documents, trust).select("first_doc_id", "best_doc_id")
