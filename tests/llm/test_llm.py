import glob
import os
import random
from datetime import datetime
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarium.llm import distinctive, fusion_rank, leakage, lookalike, names, packing, survivor
from scholarium.llm.queries import oracle_sql, queries

VECTOR = "map<string,array<struct<pos:int,weight:string>>>"
COUNTS = "array<struct<word:string,nentry:int>>"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(spark, data, name):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = queries()[name](spark, data)
    r = c.sql(oracle_sql()[name])
    want = sorted(tuple(row[r.columns.index(x)] for x in got.columns) for row in r.fetchall())
    rows = sorted(tuple(x) for x in got.collect())
    assert len(rows) == len(want)
    assert all(a == tuple(pytest.approx(x, abs=2e-6) if isinstance(x, float) else x for x in b) for a, b in zip(rows, want))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_runs_distinct(spark, data, name):
    rows = queries()[name](spark, data).collect()
    assert len(set(rows)) == len(rows)


# Distinctive terms


def vec(**tf):
    return {w: [(i, "A") for i in range(n)] for w, n in tf.items()}


def test_distinctive_terms(spark):
    rows = [
        (1, vec(rare=3, common=1, Case=2, case=1), None, "w"), (2, vec(rare=1, common=5), [("ignored", 9)], "w"), (3, None, [("Common", 2), ("common", 2), ("x", None), (None, 3), ("case", 0)], None),
        (4, None, None, ""), (5, {}, [("rare", 7)], "w"), (6, None, [None, ("common", 1)], "w"), (6, None, [("common", 1)], "w"),
    ]
    df = spark.createDataFrame(rows, f"doc_id long, tsv {VECTOR}, freqs {COUNTS}, word string")
    got = {(r.doc_id, r.word): r for r in distinctive.distinctive_terms(df).collect()}
    assert got[1, "case"].tf == 3 and got[3, "common"].tf == 4 and got[1, "rare"].df == 2 and got[2, "common"].df == 5
    assert not any(k[0] in (4, 5) for k in got) and (3, "x") not in got
    lengths = [7, 6, 4, 1, 1]
    n, df_, tf, length = 7, 2, 3, 7
    idf = np.log(1 + (n - df_ + 0.5) / (df_ + 0.5))
    want = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / np.mean(lengths)))
    assert got[1, "rare"].score == pytest.approx(want)
    assert got[1, "rare"].score > got[1, "common"].score
    assert {tuple(r) for r in distinctive.found(df).collect()} == {(1, "rare"), (2, "common"), (3, "common")}
    assert distinctive.distinctive_terms(df.limit(0)).count() == 0


# One ranking from several scores


def test_combined_ranking(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0.0, rng.expovariate(1e-3)]), rng.choice([None, float("nan"), rng.gauss(0, 1)]), rng.random()) for i in range(200)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "doc_id long, relevance_doc double, relevance_aut double, rank double").withColumn("combined", F.lit("x"))
    got = {r.doc_id: r for r in fusion_rank.combined_ranking(df, "doc_id", fusion_rank.SCORES).collect()}
    assert len(got) == 200
    one = {r[0]: r for r in rows}
    for col, k in (("relevance_doc", 1), ("relevance_aut", 2), ("rank", 3)):
        values = [r[k] for r in one.values() if r[k] is not None and r[k] == r[k]]
        for i, r in one.items():
            known = r[k] is not None and r[k] == r[k]
            want = sum(v > r[k] for v in values) / len(values) if known else None
            assert got[i][f"{col}_above"] == (pytest.approx(want) if known else None)
    top = {i for i, r in got.items() if all(r[f"{c}_above"] is not None and r[f"{c}_above"] < 0.1 for c in fusion_rank.SCORES)}
    assert {r.doc_id for r in fusion_rank.found(df).collect()} == top
    up = spark.createDataFrame([(i, float(i), i * 1e6 + 1, float(i**3)) for i in range(50)], "doc_id long, relevance_doc double, relevance_aut double, rank double")
    order = [r.doc_id for r in fusion_rank.combined_ranking(up, "doc_id", fusion_rank.SCORES).orderBy("combined").collect()]
    assert order == list(range(50))
    assert fusion_rank.combined_ranking(up.limit(0), "doc_id", fusion_rank.SCORES).count() == 0
    assert fusion_rank.combined_ranking(up.withColumn("rank", F.lit(1.0)), "doc_id", fusion_rank.SCORES).count() == 50


# Look-alike texts


SAME = [
    ("ﬁne text", "fine text"), ("Ａｂｃ１", "Abc1"), ("café", "café"), ("zero​width", "zerowidth"), ("no break", "no break"), ("рау", "pay"), ("ӓ", "ä"), ("non‑breaking", "non-breaking"), ("a\r\nb", "a\nb"), ("soft­hyphen", "softhyphen"), ("µ", "μ"),
]
DIFFERENT = [("x²", "x2"), ("The", "the"), ("resume", "résumé"), ("a\nb", "a b"), ("word", "ward"), ("1", "2"), ("ab", "a b"), ("a;b", "a,b")]


def test_visual_forms():
    for a, b in SAME:
        assert lookalike.visual_form(a) == lookalike.visual_form(b), (a, b)
        assert lookalike.consistent_form(a) == lookalike.consistent_form(b)
    for a, b in DIFFERENT:
        assert lookalike.visual_form(a) != lookalike.visual_form(b), (a, b)
    for a, b in (("Straße", "STRASSE"), ("x²", "x2"), ("Ａ", "a")):
        assert lookalike.consistent_form(a) == lookalike.consistent_form(b)
    assert lookalike.visual_form("") == "" and lookalike.visual_form("​  ") == ""


def test_lookalike_pairs(spark):
    texts = [None, "", "​", " "] + [x for p in SAME + DIFFERENT for x in p] + ["fine text", "fine text", "long " * 20000, "long " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("form", F.lit(1))
    want = set()
    for (i, a), (j, b) in combinations(enumerate(texts), 2):
        if a and b and a != b and lookalike.visual_form(a).strip() and lookalike.visual_form(a) == lookalike.visual_form(b):
            want.add((i, j))
    assert {tuple(r) for r in lookalike.found(df).collect()} == want and len(want) > 12
    assert lookalike.found(df.limit(0)).count() == 0
    forms = df.select("text", lookalike.consistent("text").alias("f")).collect()
    assert all((r.text is None) == (r.f is None) for r in forms)


def test_lookalikes_of_a_hot_text(spark):
    """Nine tenths of the rows hold one string: the few that only look like it are paired with each of them, the copies with none."""
    rows = [(i, "one hot text" if i % 10 else "one\u200b hot text" if i % 20 else "one  hot text ") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in lookalike.found(df).collect()}
    assert got == {(a, b) for (a, x), (b, y) in combinations(rows, 2) if x != y}
    classes = lookalike.look_classes(df).collect()
    assert len(classes) == 200 and {(r["class"], r.n_spellings) for r in classes} == {(0, 3)}


def test_ranking_of_a_hot_score(spark):
    """Nine tenths of the rows hold one score or none."""
    rows = [(i, 0.0 if i % 10 else float(i), None if i % 10 else float(-i), float(i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, relevance_doc double, relevance_aut double, rank double")
    got = {r.doc_id: r for r in fusion_rank.combined_ranking(df, "doc_id", fusion_rank.SCORES).collect()}
    for i, a, b, _ in rows:
        assert got[i].relevance_doc_above == pytest.approx(sum(r[1] > a for r in rows) / 400)
        assert got[i].relevance_aut_above == (None if b is None else pytest.approx(sum(r[2] is not None and r[2] > b for r in rows) / 40))
    order = fusion_rank.ranking(df, "doc_id", fusion_rank.SCORES).collect()
    assert sorted(r.place for r in order) == list(range(1, 401))
    by = sorted(order, key=lambda r: (-r.combined, r.doc_id))
    assert [r.place for r in by] == list(range(1, 401))
    assert fusion_rank.ranking(df.limit(0), "doc_id", fusion_rank.SCORES).count() == 0


def test_lookalike_on_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {tuple(sorted((a.doc_id, b.doc_id))) for a, b in combinations([d for d in docs if d.text and lookalike.visual_form(d.text).strip()], 2) if a.text != b.text and lookalike.visual_form(a.text) == lookalike.visual_form(b.text)}
    assert {tuple(r) for r in queries()["p8_found"](spark, data).collect()} == want


def test_works_of_a_long_chain(spark):
    """A record five hops from a DOI belongs to it."""
    letters = lambda c, n: c * n
    rows = [(i, "10.1234/chain" if i == 0 else None, letters("abcd"[i // 2], 30), letters("wxyz"[(i - 1) // 2], 80) if i else None, None, "Ann Lee", None, None) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, doi string, title string, abstract string, keywords string, authors string, container string, publication_date int")
    assert {r.doc_id: r.work for r in survivor.works(docs).collect()} == {i: "10.1234/chain" for i in range(6)}


# Leaks


def test_runs():
    a = np.arange(1, 61)
    assert leakage.longest_run(a, np.concatenate([[0] * 5, a[10:40], [0] * 9]), 12)[:2] == (30, 0)
    b = a.copy()
    b[[20, 33, 46]] = 0
    assert leakage.longest_run(a, b, 12)[:2] == (60, 3)
    b[::5] = 0
    assert leakage.longest_run(a, b, 12)[0] < 25
    assert leakage.longest_run(a, np.zeros(0, int), 12)[0] == 0
    gap = np.concatenate([a[:14], [99], a[14:30]])
    assert leakage._aligned(a, gap, 12)[0] >= 25
    assert leakage.common_subsequence(np.array([1, 2, 3, 0]), np.array([3, 1, 9, 2, 0])) == 2


def test_leaks(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(100, 999)}x{i}" for i in range(600)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [say(70) for _ in range(6)] + ["Only seven words stand in this item"]
    cut = items[1].split()
    swapped = [w if i % 13 else "other" for i, w in enumerate(items[2].split())]
    texts = [
        say(300) + " " + items[0] + " " + say(300), say(100) + " " + " ".join(cut[20:46]) + " " + say(100), say(40) + " " + " ".join(cut[20:41]) + " " + say(40), " ".join(swapped).upper().replace("W", "Ｗ"), None, "", say(50), items[0], items[0],
        "only, seven-WORDS stand; in this item", say(20000) + " " + items[3] + " " + say(9), "​".join(items[4]) + ".",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit(5))
    evals = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (None, "x")], "item_id long, text string")
    got = {tuple(r) for r in leakage.found(docs, evals).collect()}
    assert got == {(0, 0), (1, 1), (3, 2), (7, 0), (8, 0), (9, 6), (10, 3), (11, 4)}
    assert leakage.found(docs.limit(0), evals).count() == 0 and leakage.found(docs, evals.limit(0)).count() == 0


def test_leaks_in_tiny_and_uniform_tables(spark):
    item = "one two three four five six"
    evals = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (2, item.upper()), (3, "one two four five six")], "doc_id long, text string")
    assert {tuple(r) for r in leakage.found(docs, evals).collect()} == {(1, 1), (2, 1)}
    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [say(60), say(60)]
    hot = [(i, f"{say(30)} {items[0]} {say(30)}") for i in range(40)] + [(i, say(200)) for i in range(40, 90)] + [(90, say(20) + " " + items[1])]
    evals = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {tuple(r) for r in leakage.found(spark.createDataFrame(hot, "doc_id long, text string"), evals).collect()}
    assert got == {(i, 0) for i in range(40)} | {(90, 1)}


def test_leaks_of_low_cosine(spark):
    """A short stretch of a long item among many other words of the items is found, whatever its cosine."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(4000)]
    items = [rng.sample(words, 110) for _ in range(40)]
    noise = lambda n: " ".join(rng.choice(rng.choice(items[20:])) for _ in range(n))
    texts = [f"{noise(12 + i)} {' '.join(items[i][40:65])} {noise(60)}" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    evals = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    for bound in (0.45, 0.999):
        got = leakage.leaks(docs, evals, least_cosine=bound).where("kind = 'copied'").collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(20)}


def test_sure_run():
    assert [leakage.sure_run(n, 25, 12) for n in (1, 11, 12, 13, 25, 90)] == [1, 11, 6, 6, 8, 8]


def test_many_odd_words(spark, monkeypatch):
    monkeypatch.setattr(leakage._Ids, "LIMIT", 3)
    ids = leakage._Ids({"a": 1, "b": 2})
    for _ in range(3):
        for odd in ("é", "ü", "ñ", "a b", "ö"):
            assert ids.encode(f"a {odd} B").tolist() == ([1, 1, 2, 2] if odd == "a b" else [1, 0, 2])


def test_leaks_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL").collect()
    items = spark.read.parquet(f"{data}/eval_items.parquet").collect()
    number: dict[str, int] = {}
    ids = lambda t: np.array([number.setdefault(w, len(number) + 1) for w in leakage.words_of(t)])
    item = {r.item_id: ids(r.text) for r in items}
    want = {(d.doc_id, i) for d in docs for i, w in item.items() if leakage.longest_run(w, ids(d.text), 12, 20)[0] >= min(25, len(w))}
    assert {tuple(r) for r in queries()["p7_found"](spark, data).collect()} == want


def test_leaks_reworded_and_in_passes(spark):
    """400 items are searched in three passes; an item told in other words with its rare words kept is reworded."""
    rng = random.Random(9)
    words = [f"term{i}" for i in range(5000)]
    fill = ["the", "of", "and", "with", "from", "into"]
    items = [[w for t in rng.sample(words, 40) for w in (t, rng.choice(fill))] for _ in range(400)]
    told = {5: 11, 250: 12, 399: 13}  # item -> document
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(40)]
    for item, d in told.items():  # every fourth word is another one: no stretch of 25 words is left
        texts[d] += " " + " ".join(f"other{i}" if i % 4 == 1 else w for i, w in enumerate(items[item])) + " " + texts[0]
    texts[20] += " " + " ".join(items[300][10:60])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    evals = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = leakage.leaks(docs, evals).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.kind == "reworded"} == {(d, i) for i, d in told.items()}
    assert {(r.doc_id, r.item_id) for r in got if r.kind == "copied"} == {(20, 300)}
    assert all(r.near and 0.6 <= r.common <= 1 for r in got if r.kind == "reworded")


def test_band_scores_lose_no_copied_stretch():
    """Whatever words are replaced, put in or left out, a stretch within the allowance passes the vectorised test."""
    rng = np.random.default_rng(3)
    for _ in range(150):
        item = rng.integers(1, 60, int(rng.integers(8, 100))).astype(np.int32)
        n = int(rng.integers(min(25, len(item)), len(item) + 1))
        at = int(rng.integers(0, len(item) - n + 1))
        part = item[at : at + n].tolist()
        for _ in range(n // 12):
            i, what = int(rng.integers(0, len(part))), rng.integers(0, 3)
            part[i : i + 1] = [[0], [], [part[i], 0]][what]
        doc = np.array([0] * 5 + part + [0] * 5, dtype=np.int32)
        seeds = leakage._seeds([item], 25, 12)
        table = np.ones(1 << 20, dtype=bool)
        first = np.array([0, -(-len(doc) // leakage.BLOCK)])
        diagonals = leakage._seeded(doc, np.arange(len(doc)) // leakage.BLOCK, first, seeds, [table])
        scores = leakage._band_scores(doc, np.array([0, len(doc)]), diagonals, [item], 12)
        assert scores.max() >= leakage.least_score(len(item), 25, 12)


# Packing


def test_packing(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "naïve", "γ"]) for _ in range(rng.choice([1, 5, 30, 200, 900]))) for _ in range(120)] + [None, "", "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("shard", F.lit("x"))
    budgets = spark.createDataFrame([(1, 64), (2, 512), (3, None), (4, 0)], "budget_id long, capacity_tokens int")
    sizes = {r.doc_id: r.n_tokens for r in packing.token_counts(docs).collect()}
    assert sizes[120] == sizes[121] == 0 and sizes[122] > 0
    rows = packing.pack(docs, budgets, per_shard=50).collect()
    for budget, capacity in ((1, 64), (2, 512)):
        own = [r for r in rows if r.budget_id == budget]
        load: dict[int, int] = {}
        pieces: dict[int, list] = {}
        for r in own:
            if r.container is not None:
                load[r.container] = load.get(r.container, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append(r)
        assert max(load.values()) <= capacity and set(pieces) == set(sizes)
        for i, ps in pieces.items():
            ps.sort(key=lambda r: r.piece)
            assert sum(r.n_tokens for r in ps) == sizes[i] and len(ps) == max(1, -(-sizes[i] // capacity))
            assert [r.first_token for r in ps] == [k * capacity for k in range(len(ps))]
            assert (ps[0].container is None) == (sizes[i] == 0)
        assert len(load) <= sum(sizes.values()) / capacity * 1.3 + 4
    got = {r.budget_id: r for r in packing.fill(packing.pack(docs, budgets, per_shard=50), budgets).collect()}
    for budget, capacity in ((1, 64), (2, 512)):
        own = {r.container for r in rows if r.budget_id == budget and r.container is not None}
        assert got[budget].containers == len(own) and got[budget].tokens == sum(sizes.values())
        assert got[budget].fill == pytest.approx(sum(sizes.values()) / capacity / len(own)) and got[budget].fill > 0.9 and got[budget].least <= len(own)
    assert packing.pack(docs.limit(0), budgets).count() == 0
    assert packing.pack_shard([6, 5, 5, 4], 10) in ([0, 1, 1, 0], [1, 0, 0, 1])


# Names


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Agnès Casopobin", "Casopobin, A.", True), ("Dr. Barbara Buvivenon", "B. L. Buvivenon", True), ("Bárbara L. Buvivenon", "B. M. Buvivenon", False), ("Nathaniel Drasizuven", "nate nils drasizuven", True), ("Pål Frogebogal", "Pal Frgebogal", True),
        ("University of Tesanitul", "Univ. Tesanitul", True), ("University of Prirodesul", "Prirodesul Institute of Rural History", False), ("Inst. of Soil Research (Stiteduven)", "Stiteduven Institute for Soil Research", True), ("Institute of Soil Research, Stiteduven", "Institute of Rural History, Stiteduven", False),
        ("Matthew Stondernobun", "Gérard V. Stondernobun", False), ("Bazolmomol, Ray", "Raymond Vera Bazolmomol", True), ("ARTHUR GREGOLARAL, PHD", "AI Gregolaral", True), ("Brortapizun Wojtek", "Brortapizun, Wojciech V.", True), ("Deblrah Brivarnotel", "Brivarnotel, Deborah", True),
        ("Anonymous", "anonymous", False), ("JO BRUNDESSOSUN", "jo brundesosun", True), ("PA Nubupekon", "pa nubupekon", True), ("Josephine Brundesosun", "jo brundesosun", True), ("Prezebemon Lab.", "Laboratories of Prezebemon", True), ("James Krunonelun", "Pål H. Krunonelun", False),
    ],
)
def test_name_pairs(spark, a, b, same):
    df = spark.createDataFrame([(1, a), (2, b)], "aut_id long, aut_name string")
    assert (names.found(df).count() == 1) == same


def test_names_together(spark):
    rows = ["Thomas Nubupekon", "Theodore Nubupekon", "T. Nubupekon", "Nubupekon, Tom", "Ted Nubupekon", "Theodore A. Nubupekon", "T. A. Nubupekon", None, "", "-", "n/a", "et al.", "X", "Long " + "x" * 3000]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(rows)], "aut_id long, aut_name string").withColumn("entity", F.lit(0))
    assert {tuple(r) for r in names.found(df).collect()} == {(0, 3), (1, 4), (1, 5), (4, 5), (1, 6), (4, 6), (5, 6)}
    assert names.found(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "Agnes Casopobin") for i in range(4)], "aut_id long, aut_name string")
    assert names.found(copies).count() == 6


def test_metric_join_is_exact(spark):
    rng = random.Random(4)
    values = list({"".join(rng.choice("abeiolx") for _ in range(rng.randint(1, 7))) for _ in range(500)})
    df = spark.createDataFrame([("b", v) for v in values], "k string, v string")
    want = {(min(a, b), max(a, b)) for a, b in combinations(values, 2) if names.edit_distance(a, b, 1) <= 1}
    assert {(r.lo, r.hi) for r in names.metric_join(df, "k", "v").collect()} == want and len(want) > 50
    some = values[:250]
    want = {(min(a, b), max(a, b)) for a, b in combinations(some, 2) if names.edit_distance(a, b, 2) <= 2}
    assert {(r.lo, r.hi) for r in names.metric_join(df.where(F.col("v").isin(some)), "k", "v", 2).collect()} == want and len(want) > 100
    assert len(names.reachable(1)) == 31


def test_wider_radius(spark):
    rows = ["Jonathan Stevensonbury", "Jonathan Stvensonbry", "Univrsity fo Tesanitul", "University of Tesanitul", "Ann Lee", "Ann Lem"]
    df = spark.createDataFrame(list(enumerate(rows)), "aut_id long, aut_name string")
    pairs = lambda radius: {(r.aut_id, r.entity) for r in names.linked(df, radius=radius).collect()}
    assert pairs(1) == {(2, 2), (3, 2)} and pairs(2) == {(0, 0), (1, 0), (2, 2), (3, 2)}


def test_entities(spark):
    df = spark.createDataFrame([(1, "Agnes Casopobin"), (2, "Casopobin, Agnes"), (3, "Bob Ray"), (4, None)], "aut_id long, aut_name string")
    assert {tuple(r) for r in names.entities(df).collect()} == {(1, 1, 2), (2, 1, 2)}


def test_edit_distance():
    for a, b, d in (("ab", "ba", 1), ("abc", "abc", 0), ("abcd", "acbd", 1), ("kitten", "sitting", 3), ("", "ab", 2), ("ca", "abc", 2)):
        assert names.edit_distance(a, b, 5) == d


# Survivors

DOCS = "doc_id long, doi string, title string, abstract string, keywords string, authors string, publication_date int, container string, source string, added_at timestamp_ntz"
LONG_TITLE = "On the porous interpallet of melody: stratification of 467 curated sites"
LONG_ABSTRACT = "Readers who explore a beetle rarely open more than 182 entries of the dense street, and the rest of them reads on for a while without any pause."


def doc(i, doi=None, title=None, abstract=None, keywords=None, source=None, at=1, authors="Ann Lee; Bob Ray", container="Acta", year=2001):
    return (i, doi, title, abstract, keywords, authors, year, container, source, datetime(2020, 1, at))


def best(spark, rows):
    trust = spark.createDataFrame([("feed", 5), ("upload", 1)], "source string, trust int")
    return {r.first_doc_id: r for r in survivor.best_records(spark.createDataFrame(rows, DOCS).withColumn("work", F.lit("x")), trust).collect()}


def test_forms(spark):
    df = spark.createDataFrame([(x,) for x in ("https://doi.example.org/10.99005/JX.1", "doi: 10.99005/ jx.1.", "10.99005/jx.1", "n/a", None, "pending")], "d string")
    assert [r[0] for r in df.select(survivor.doi_form(F.col("d"))).collect()] == ["10.99005/jx.1"] * 3 + [None] * 3
    df = spark.createDataFrame([(x,) for x in ("ABSTRACT: A b-c.", "a  bc", "No abstract available.", " ", None, "Straße")], "d string")
    assert [r[0] for r in df.select(survivor.value_form(F.col("d"))).collect()] == ["abc", "abc", None, None, None, "strasse"]


def test_survivor_rules(spark):
    got = best(spark, [
        doc(1, "10.99005/a.1", LONG_TITLE, LONG_ABSTRACT[:60], "k; l", "feed"), doc(2, "doi:10.99005/A.1", LONG_TITLE.upper(), "Summary - " + LONG_ABSTRACT, "k, l", "upload"),
        doc(3, "n/a", LONG_TITLE[:40] + "...", LONG_ABSTRACT, None, "feed", authors="Ann Lee and Bob Ray"),
        doc(4, "10.99005/b.1", LONG_TITLE, None, None, "feed", authors="Kim Poe"), doc(5, None, "Preface", None, None), doc(6, None, "Preface", None, None, authors="Kim Poe", container="Other"), doc(None, "10.99005/b.1"),
    ])
    assert set(got) == {1} and got[1].best_doc_id == 2 and got[1].n_records == 3
    assert survivor.value_form and got[1].abstract.endswith(LONG_ABSTRACT) and got[1].doi.lower().endswith("10.99005/a.1")
    ties = best(spark, [doc(1, "10.99005/a.1", LONG_TITLE, source="upload", at=9), doc(2, "10.99005/a.1", LONG_TITLE, source="feed", at=1), doc(3, "10.99005/a.1", LONG_TITLE, source="feed", at=2), doc(4, "10.99005/a.1", LONG_TITLE, source=None, at=30)])
    assert ties[1].best_doc_id == 3
    assert best(spark, [doc(9, "10.99005/z.1"), doc(9, "10.99005/z.1")]) == {} and best(spark, []) == {}
    again = best(spark, [doc(1, "10.99005/a.1", LONG_TITLE), doc(1, "10.99005/a.1", LONG_TITLE), doc(2, "10.99005/a.1")])
    assert again[1].n_records == 2 and again[1].best_doc_id == 1


def test_survivor_without_dois(spark):
    got = best(spark, [doc(1, None, LONG_TITLE, LONG_ABSTRACT), doc(2, None, None, LONG_ABSTRACT), doc(3, None, LONG_TITLE, None), doc(4, None, "Another title that is long enough to tell", None, authors=None, container=None, year=0)])
    assert set(got) == {1} and got[1].n_records == 3 and got[1].best_doc_id == 1


def test_many_copies_of_one_work(spark):
    rows = [doc(i, "10.99005/hot.1" if i % 2 else None, LONG_TITLE, LONG_ABSTRACT, "k", "feed", 1 + i % 28) for i in range(400)]
    got = best(spark, rows)
    assert set(got) == {0} and got[0].n_records == 400
    assert got[0].best_doc_id % 2 == 1 and rows[got[0].best_doc_id][9].day == max(r[9].day for r in rows if r[1])


def test_dependence():
    copying = survivor._dependence([("a", "b", 50, 30, 5)], {"a": 0.8, "b": 0.8})["a", "b"]
    alone = survivor._dependence([("a", "b", 60, 0, 30)], {"a": 0.8, "b": 0.8})["a", "b"]
    assert copying > 0.9 > 0.5 > alone


def test_cut_marks_and_ampersands(spark):
    """A value cut short with a remark behind it, or with & for and, is the value."""
    got = best(spark, [
        doc(1, "10.99005/a.1", LONG_TITLE[:50] + " (truncated)", LONG_ABSTRACT, "k"), doc(2, "10.99005/a.1", LONG_TITLE, LONG_ABSTRACT[:70] + " [...]", "k"),
        doc(3, "10.99005/a.1", LONG_TITLE, LONG_ABSTRACT, "k"),
    ])
    assert got[1].best_doc_id == 3
    both = best(spark, [doc(1, "10.99005/a.1", "Salt & ice of the far and quiet north sea"), doc(2, None, "Salt and ice of the far & quiet north sea"), doc(3, None, "Soil maps", year=1999), doc(4, None, "Soil maps", year=1999), doc(5, None, "Soil maps", year=2000)])
    assert {(r.first_doc_id, r.n_records) for r in both.values()} == {(1, 2), (3, 2)}


def test_whole_forms(spark):
    """A beginning stands for the whole that it begins, unless two wholes begin alike."""
    rows = [("b1", x) for x in ("aa", "aab", "aabc", "ba", "bab", "bac", "bacd", "c")] + [("b2", "aa"), ("b2", "b")]
    df = spark.createDataFrame([(b, f) for b, f in rows], "b string, form string").select(F.lit(1).alias("head"), F.xxhash64("b").alias("block"), "form", "b")
    name = {r.key: (r.b, r.form) for r in df.select("b", "form", F.xxhash64("block", "form").alias("key")).collect()}
    got = {name[r.key]: name[r.whole] for r in survivor._whole_forms(df.drop("b")).collect()}
    assert got == {("b1", "aa"): ("b1", "aabc"), ("b1", "aab"): ("b1", "aabc"), ("b1", "bac"): ("b1", "bacd")}


def test_same_opening_is_not_enough(spark):
    """Abstracts that open alike for 200 letters and go on differently link nobody."""
    opening = "The following abstract opens with words that a whole series of reports has in common " * 3
    rows = [doc(i, None, None, f"{opening} and then tells of subject number {i} only", None, authors=None, container=None, year=0) for i in range(4)]
    rows += [doc(9, None, None, f"{opening} and then tells of subject number 2 only", None, authors=None, container=None, year=0)]
    assert {(r.first_doc_id, r.n_records) for r in best(spark, rows).values()} == {(2, 2)}


def fused_by_hand(claims, rounds=2, false_values=10, copied=0.8, prior=0.2):
    """The posterior of each value, with every pair of claims looked at."""
    claims = sorted(set(claims))
    sources = sorted({c[3] for c in claims})
    values = sorted({c[:3] for c in claims})
    accuracy, depends = {s: 0.8 for s in sources}, {}
    for turn in range(rounds + 1):
        order = sorted(sources, key=lambda s: (-accuracy[s], s))
        score = {}
        for v in values:
            mine = [s for s in order if (*v, s) in claims]
            score[v] = 0.0
            for i, s in enumerate(mine):
                vote = np.log(false_values * accuracy[s] / (1 - accuracy[s]))
                for t in mine[:i]:
                    vote *= 1 - copied * depends.get((min(s, t), max(s, t)), 0.0)
                score[v] += vote
        posterior = {v: np.exp(score[v]) / sum(np.exp(score[u]) for u in values if u[:2] == v[:2]) for v in values}
        if turn == rounds:
            return posterior
        accuracy = {s: min(0.99, max(0.05, np.mean([posterior[c[:3]] for c in claims if c[3] == s]))) for s in sources}
        seen = {}
        for c, e in combinations(claims, 2):
            for x, y in ((c, e), (e, c)):
                if x[:2] == y[:2] and x[3] < y[3]:
                    n = seen.setdefault((x[3], y[3]), [0, 0, 0])
                    n[2 if x[2] != y[2] else 0 if posterior[x[:3]] > 0.5 else 1] += 1
        depends = survivor._dependence([(*k, *n) for k, n in seen.items()], accuracy, copied, false_values, prior)


def test_fused_values_against_brute_force(spark):
    rng = random.Random(12)
    truth = {(w, f): f"true{w}{f}" for w in range(30) for f in "ab"}
    claims = []
    for (w, f), t in truth.items():
        wrong = f"false{rng.randint(0, 3)}"
        for s, right in (("good", 0.95), ("fair", 0.8), ("bad", 0.4)):
            value = t if rng.random() < right else f"false{rng.randint(0, 3)}"
            claims.append((w, f, value, s))
            if s == "bad":
                claims += [(w, f, value if rng.random() < 0.9 else wrong, "copy")]
        claims += claims[-1:] * rng.randint(0, 2)
    got = survivor.fused_values(spark.createDataFrame(claims, "work int, field string, form string, source string"))
    want = fused_by_hand(claims)
    assert {(r.work, r.field, r.form): pytest.approx(r.posterior) for r in got.collect()} == want
    assert survivor.fused_values(spark.createDataFrame([], "work int, field string, form string, source string")).count() == 0
    with pytest.raises(ValueError):
        survivor.fused_values(spark.createDataFrame([(1, "a", "x", f"s{i}") for i in range(300)], "work int, field string, form string, source string"))
