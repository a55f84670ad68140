"""Differently typed names of one person or organisation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.functions.visible import UNDECOMPOSED
from scholarium.llm.lookalike import consistent_form
from scholarium.operators.components import connected_components
from scholarium.plans.lineage import cut

# Short forms of given names, and the full names that they stand for.
NICKNAMES = {
    "abby": "abigail", "gail": "abigail", "al": "albert alan alexander", "alex": "alexander", "andy": "andrew", "tony": "anthony", "art": "arthur", "barb": "barbara", "babs": "barbara", "bea": "beatrice", "trixie": "beatrice", "ben": "benjamin", "becky": "rebecca", "bob": "robert", "rob": "robert", "bobby": "robert",
    "cathy": "catherine", "kathy": "catherine", "kate": "catherine", "cate": "catherine", "charlie": "charles", "chuck": "charles", "chris": "christopher christine", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dot": "dorothy", "dottie": "dorothy", "dolly": "dorothy",
    "ed": "edward edwin", "eddie": "edward", "ned": "edward", "ted": "theodore edward", "teddy": "theodore", "theo": "theodore", "ellie": "eleanor", "nora": "eleanor", "nell": "eleanor", "liz": "elizabeth", "eliza": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "fred": "frederick", "freddie": "frederick",
    "jeff": "geoffrey jeffrey", "geoff": "geoffrey", "jerry": "gerald", "gerry": "gerald", "greg": "gregory", "hal": "harold henry", "harry": "harold henry", "hank": "henry", "jim": "james", "jimmy": "james", "jamie": "james", "jen": "jennifer", "jenny": "jennifer", "joe": "joseph", "joey": "joseph", "jo": "josephine", "josie": "josephine", "jos": "joseph",
    "ken": "kenneth", "kenny": "kenneth", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael", "nate": "nathaniel", "nat": "nathaniel", "nick": "nicholas", "nicky": "nicholas",
    "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "pete": "peter", "phil": "philip", "ray": "raymond", "rich": "richard", "rick": "richard", "dick": "richard", "ron": "ronald", "sam": "samuel", "steve": "stephen steven", "sue": "susan", "susie": "susan", "tim": "timothy", "tom": "thomas", "tommy": "thomas",
    "vic": "victoria victor", "vicky": "victoria", "tori": "victoria", "will": "william", "bill": "william", "billy": "william", "wojtek": "wojciech", "walt": "walter", "zach": "zachary",
}
# Words that tell what kind of organisation a name is.
KINDS = {
    "university": "university", "univ": "university", "institute": "institute", "inst": "institute", "library": "library", "libr": "library", "lib": "library", "laboratories": "laboratory", "laboratory": "laboratory", "labs": "laboratory", "lab": "laboratory", "museum": "museum", "mus": "museum", "consortium": "consortium", "cons": "consortium",
    "college": "college", "academy": "academy", "acad": "academy", "department": "department", "dept": "department", "school": "school", "society": "society", "soc": "society", "centre": "centre", "center": "centre", "foundation": "foundation", "council": "council", "hospital": "hospital", "observatory": "observatory",
}
# Words without weight in an organisation's name; titles of persons; names of nobody.
SMALL = {"of", "for", "the", "and", "in", "at", "on", "de", "national", "natl", "nat", "ntl"}
TITLES = {"dr", "prof", "professor", "phd", "md", "mr", "mrs", "ms", "msc", "bsc", "jr", "sr", "sir", "ing"}
NOBODY = {"", "anonymous", "anon", "unknown", "unknownauthor", "authorunknown", "nobody", "none", "na", "null", "nan", "etal", "others", "andothers", "various", "authornotstated", "notstated", "noauthor", "tba", "untitled", "editor", "staff", "variousauthors", "author", "authors"}

_SMALL_LETTERS = {"".join(sorted(w)) for w in SMALL}  # letters typed in another order make no weight

PIVOT_LETTERS = "aeio"


def edit_distance(a: str, b: str, most: int = 2) -> int:
    """Damerau-Levenshtein distance (insertion, deletion, replacement, exchange of neighbours), ``most`` + 1 where larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    last: dict[str, int] = {}
    big = len(a) + len(b)
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            same = a[i - 1] == b[j - 1]
            if same:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return min(d[-1][-1], most + 1)


def _plain(text: str) -> str:
    text = "".join(UNDECOMPOSED.get(c, c) for c in consistent_form(text))
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=200_000)
def _kind(word: str) -> str | None:
    """The kind of organisation that a word tells, also with one typing error in a long word; each distinct word is looked up once."""
    if word in KINDS:
        return KINDS[word]
    return next((KINDS[k] for k in KINDS if len(k) >= 6 and len(word) >= 6 and edit_distance(word, k, 1) <= 1), None)


def readings(name: str | None) -> list[tuple[str, str, str, str]]:
    """(kind, family, given, middle) of every way to read a name; none where it names nobody.

    kind is "P" for a person, else "O:" and the kind of organisation. For organisations family is one
    word and given the others, one reading a word. A given name may be one letter. Accents, letter
    case, titles and nicknames in brackets do not matter.
    """
    if not name:
        return []
    raw = re.sub(r"\([^)]*\)", lambda m: m[0] if any(w in KINDS for w in _LETTERS.findall(_plain(name))) else " ", name)
    plain = _plain(raw)
    words = _LETTERS.findall(plain)
    if "".join(words) in NOBODY or not words:
        return []
    kinds = [(w, _kind(w)) for w in words]
    if any(k for _, k in kinds):
        kind = sorted(k for _, k in kinds if k)[0]
        rest = sorted(w for w, k in kinds if not k and "".join(sorted(w)) not in _SMALL_LETTERS)
        return [("O:" + kind, w, " ".join(rest[:i] + rest[i + 1 :]), "") for i, w in enumerate(rest)]
    one_case = raw in (raw.upper(), raw.lower())
    doubtful = one_case and any(len(w) == 2 and w in NICKNAMES for w in words)
    out: list[tuple[str, str, str, str]] = []
    for split in (True, False) if doubtful else (True,):  # "JO SMITH" may be J. O. Smith or Jo Smith
        out += [r for r in _person(raw, one_case, split) if r not in out]
    return out


def _parts(text: str, one_case: bool, split: bool) -> list[str]:
    """Plain words and initials of a person's name; initials written together come apart."""
    out = []
    for w in _LETTERS.findall(unicodedata.normalize("NFC", text)):
        p = _plain(w)
        if p in TITLES:
            continue
        capitals = w.upper() == w and w.lower() != w
        if len(p) == 2:
            together = split if one_case and p in NICKNAMES else capitals or one_case
        else:
            together = len(p) == 3 and capitals and not any(c in "aeiouy" for c in p[1:-1])
        out += list(p) if together else [p]
    return out


def _person(raw: str, one_case: bool, split: bool) -> list[tuple[str, str, str, str]]:
    parts = lambda text: _parts(text, one_case, split)
    before, comma, after = raw.partition(",")
    if comma and not parts(after):
        comma, raw = "", before
    if comma:
        family, rest = parts(before), parts(after) or [""]
        family = [p for p in family if len(p) > 1] or family
        return [("P", " ".join(family), rest[0], rest[1] if len(rest) > 1 else "")] if family else []
    tokens = parts(raw)
    full = [i for i, t in enumerate(tokens) if len(t) > 1]
    if not full:
        return []
    if len(full) == 1:
        others = [t for i, t in enumerate(tokens) if i != full[0]]
        return [("P", tokens[full[0]], others[0] if others else "", others[1] if len(others) > 1 else "")]
    last = full[-1]
    given = tokens[:last] or [""]
    out = [("P", tokens[last], given[0], given[1] if len(given) > 1 else "")]
    if len(full) == len(tokens):  # an initial is never the family, so its place tells the order
        out.append(("P", tokens[0], tokens[1], tokens[2] if len(tokens) > 2 else ""))
    return out


def full_names(given: str) -> set[str]:
    """The full given names that a given name may stand for."""
    return set(NICKNAMES.get(given, given).split()) if given else set()


def errors_allowed(a: str, b: str, radius: int = 1, letters: int = 4) -> int:
    """Typing errors that two words may differ by: one for each ``letters`` letters of the shorter, at most ``radius``."""
    return min(radius, min(len(a), len(b)) // letters)


def agree(a: tuple[str, str, str], b: tuple[str, str, str], far: int, radius: int = 1) -> bool:
    """Whether two readings (family, given, middle) within the radius can name one person; ``far`` tells that the families differ.

    Only one of the words may be mistyped; a family name needs five letters an error, a given or middle name four.
    """
    if far and edit_distance(a[0], b[0], radius) > errors_allowed(a[0], b[0], radius, 5):
        return False
    if not a[1] or not b[1]:
        return not a[1] and not b[1] and not far
    if a[2] and b[2] and not (a[2] == b[2] if len(a[2]) > 1 and len(b[2]) > 1 else a[2][0] == b[2][0]):
        if far or edit_distance(a[2], b[2], radius) > errors_allowed(a[2], b[2], radius):
            return False
    x, y = full_names(a[1]), full_names(b[1])
    if len(a[1]) == 1 or len(b[1]) == 1:
        return bool({w[0] for w in x} & {w[0] for w in y})
    if x & y:
        return True
    return not far and any(edit_distance(p, q, radius) <= errors_allowed(p, q, radius) for p in x | {a[1]} for q in y | {b[1]})


def _profiles(authors: DataFrame, key: str, name: str) -> DataFrame:
    """(key, kind, family, given, middle, initials) of all readings; initials are those of the given names it may stand for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *r, "".join(sorted({w[0] for w in full_names(r[2])}))) for k, n in zip(batch["_key"], batch["_name"]) for r in readings(n)]
            yield pd.DataFrame(out, columns=["_key", "kind", "family", "given", "middle", "initials"])

    rows = authors.select(F.col(key).alias("_key"), F.col(name).alias("_name")).where("_key IS NOT NULL AND _name IS NOT NULL")
    return rows.mapInPandas(run, f"_key {dict(authors.dtypes)[key]}, kind string, family string, given string, middle string, initials string")


def metric_join(items: DataFrame, block: str, value: str, radius: int = 1) -> DataFrame:
    """(block, lo, hi): all pairs of different values of one block within ``radius`` edits, by metric-space partitioning.

    Pivots are the empty string and, for each of four letters, a long run of that letter. With the
    Damerau-Levenshtein metric the distance of x to the empty string is its length, and to a run of a
    (longer than x) the run's length less the number of a in x, so pivot distances need no dynamic
    program. A cell is the vector of the distances to all pivots. By the triangle inequality values
    within the radius differ by at most the radius in each of them; only some of those neighbouring cells (31
    for one edit, 261 for two) can be reached, and a value is replicated to them. Inside a cell each pair is compared by the
    true metric, so the result is exact.
    """
    distinct = items.select(F.col(block).alias("block"), F.col(value).alias("v")).distinct()
    counts = [F.length("v") - F.length(F.replace(F.col("v"), F.lit(c), F.lit(""))) for c in PIVOT_LETTERS]
    homes = cut(distinct.select("block", "v", F.length("v").alias("p0"), *[c.alias(f"p{i}") for i, c in enumerate(counts, 1)]))
    n = len(PIVOT_LETTERS)
    shifted = F.explode(F.array(*[F.array(*[F.lit(x) for x in m]) for m in reachable(radius)])).alias("m")
    cell = lambda *p: F.xxhash64("block", *p)
    home = homes.select(cell(*[f"p{i}" for i in range(n + 1)]).alias("cell"), F.col("block").alias("home_block"), F.col("v").alias("hi"))
    guest = homes.select("block", "v", *[f"p{i}" for i in range(n + 1)], shifted)
    guest = guest.select("block", F.col("v").alias("lo"), cell(*[F.col(f"p{i}") + F.col("m")[i] for i in range(n + 1)]).alias("cell"))
    # an exchange of neighbours is one edit of the metric and two of Levenshtein's, which is the quicker test
    near = guest.join(home, "cell").where("block = home_block AND lo < hi").withColumn("d", F.levenshtein("lo", "hi", 2 * radius)).where("d >= 0")

    @F.pandas_udf("boolean")
    def within(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(x, y, radius) <= radius for x, y in zip(a, b)], dtype=bool)

    return near.where(F.col("d") <= radius).select("block", "lo", "hi").union(near.where(F.col("d") > radius).where(within("lo", "hi")).select("block", "lo", "hi"))


def reachable(radius: int) -> list[tuple[int, ...]]:
    """How length and letter counts can change by up to ``radius`` edits."""
    one = [m for m in product((-1, 0, 1), repeat=len(PIVOT_LETTERS) + 1) if _one_edit(m)]
    moves = {(0,) * (len(PIVOT_LETTERS) + 1)}
    for _ in range(radius):
        moves = {tuple(x + y for x, y in zip(m, e)) for m in moves for e in one}
    return sorted(moves)


def _one_edit(move: tuple[int, ...]) -> bool:
    """Whether one edit can change length and letter counts like this."""
    length, letters = move[0], move[1:]
    up, down = letters.count(1), letters.count(-1)
    if length == 0:
        return up <= 1 and down <= 1
    return (up, down) in ((0, 0), (1, 0) if length == 1 else (0, 1))


def linked(authors: DataFrame, key: str = "aut_id", name: str = "aut_name", radius: int = 1) -> DataFrame:
    """(key, entity): every name that shares an entity with another; entity is the smallest key of it.

    Names are read as persons (in both orders where no comma tells) or organisations. Readings meet
    within blocks (kind and first letter of the given name; or the same family name; or the same other
    words of an organisation) by ``metric_join``, so up to ``radius`` typing errors in any one word are
    bridged (fewer in short words, see errors_allowed), and chains of spellings join up. Persons agree if the given names do (nicknames, initials, one error)
    and the middle ones do not differ. A name with only initials joins the one entity it fits; where it
    fits several, the one whose middle initial it shares, and if that leaves more or none it stays
    apart. Null, blank and stand-in names belong to no entity. Equal readings are compared once,
    whatever their number. An empty table gives no rows.
    """
    rows = cut(_profiles(authors, key, name))
    reading = ["kind", "family", "given", "middle"]
    profiles = cut(rows.groupBy(*reading, "initials").agg(F.min("_key").alias("rep")))
    same = rows.drop("initials").join(profiles, reading).where("_key <> rep").select(F.col("_key").alias("a"), F.col("rep").alias("b"))

    persons = profiles.where("kind = 'P'")
    by_initial = persons.select(F.explode(F.split("initials", "")).alias("i"), "*").where("i <> '' OR initials = ''").select(F.concat(F.lit("P|"), "i").alias("block"), F.col("family").alias("v"), *reading, "rep")
    by_family = persons.where("length(given) > 1").select(F.concat(F.lit("F|"), "family").alias("block"), F.col("given").alias("v"), *reading, "rep")
    bodies = profiles.where("kind <> 'P'").select(F.concat("kind", F.lit("|"), "given").alias("block"), F.col("family").alias("v"), *reading, "rep")
    items = cut(by_initial.union(by_family).union(bodies))
    near = metric_join(items, "block", "v", radius)
    side = lambda s: items.select("block", F.col("v").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in (*reading, "rep")])
    apart = near.join(side("lo"), ["block", "lo"]).join(side("hi"), ["block", "hi"])
    equal = items.where("block LIKE 'P|%'").select("block", F.col("v").alias("lo"), *[F.col(c).alias(f"{c}_lo") for c in (*reading, "rep")]).join(
        items.select("block", F.col("v").alias("lo"), *[F.col(c).alias(f"{c}_hi") for c in (*reading, "rep")]), ["block", "lo"]
    ).where("rep_lo < rep_hi")
    columns = [f"{c}_{s}" for s in ("lo", "hi") for c in (*reading, "rep")]

    @F.pandas_udf("boolean")
    def fits(kind: pd.Series, fa: pd.Series, ga: pd.Series, ma: pd.Series, fb: pd.Series, gb: pd.Series, mb: pd.Series) -> pd.Series:
        return pd.Series([k != "P" or agree((a, b, c), (d, e, f), int(a != d), radius) for k, a, b, c, d, e, f in zip(kind, fa, ga, ma, fb, gb, mb)], dtype=bool)

    pairs = apart.select(*columns).union(equal.select(*columns)).where("rep_lo <> rep_hi").distinct()
    pairs = cut(pairs.where(fits("kind_lo", "family_lo", "given_lo", "middle_lo", "family_hi", "given_hi", "middle_hi")))
    short = lambda s: (F.col(f"kind_{s}") == "P") & (F.length(f"given_{s}") <= 1)
    whole = pairs.where(~short("lo") & ~short("hi")).select(F.col("rep_lo").alias("a"), F.col("rep_hi").alias("b"))
    parts = connected_components(whole.union(same), "a", "b")

    shared = (F.col("middle_lo") != "") & (F.col("middle_hi") != "")
    half = pairs.where(short("lo") & ~short("hi")).select(F.col("rep_lo").alias("short"), F.col("rep_hi").alias("node"), shared.alias("sure"))
    half = half.union(pairs.where(~short("lo") & short("hi")).select("rep_hi", "rep_lo", shared))
    half = half.join(parts, "node", "left").withColumn("target", F.coalesce("component", "node"))
    sure = F.when(F.col("sure"), F.col("target"))
    choice = half.groupBy("short").agg(F.min("target").alias("t"), F.max("target").alias("u"), F.min(sure).alias("s"), F.max(sure).alias("r"))
    choice = cut(choice.select("short", F.when(F.col("t") == F.col("u"), F.col("t")).when(F.col("s") == F.col("r"), F.col("s")).alias("target")))
    both = pairs.where(short("lo") & short("hi")).select(F.col("rep_lo").alias("a"), F.col("rep_hi").alias("b"))
    x, y = choice.select(F.col("short").alias("a"), F.col("target").alias("ta"), F.lit(1).alias("ca")), choice.select(F.col("short").alias("b"), F.col("target").alias("tb"), F.lit(1).alias("cb"))
    both = both.join(x, "a", "left").join(y, "b", "left").where("(ca IS NULL OR ta IS NOT NULL) AND (cb IS NULL OR tb IS NOT NULL) AND (ta IS NULL OR tb IS NULL OR ta = tb)")
    edges = whole.union(same).union(choice.where("target IS NOT NULL").select("short", "target")).union(both.select("a", "b"))
    return connected_components(edges, "a", "b").select(F.col("node").alias(key), F.col("component").alias("entity"))


def entities(authors: DataFrame) -> DataFrame:
    """(aut_id, entity, n_names): one row a name that shares its entity with another."""
    groups = cut(linked(authors))
    return groups.join(groups.groupBy("entity").agg(F.count(F.lit(1)).alias("n_names")), "entity").select("aut_id", "entity", "n_names")


def found(authors: DataFrame) -> DataFrame:
    """(aut_id_a, aut_id_b): every two rows that name one entity, as the query asks; ``entities`` has one row a name."""
    groups = linked(authors)
    a, b = groups.select("entity", F.col("aut_id").alias("aut_id_a")), groups.select("entity", F.col("aut_id").alias("aut_id_b"))
    return a.join(b, "entity").where("aut_id_a < aut_id_b").select("aut_id_a", "aut_id_b")
