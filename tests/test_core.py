import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarium.functions import mathx, strings, vectors
from scholarium.operators import cluster, components, density, graph, ingest, packed, prefix, projection, quantiles, spatial, termmatrix, text
from scholarium.queries import queries
from scholarium.sources import documents_in, matrix_text
from scholarium.streaming import incremental


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_strings(spark):
    years = [(None, 0), ("2014", 2014), ("20140501", 501), ("2014-05-01", 0), ("May 2014", 0), ("abc", 0)]
    got = spark.createDataFrame([y[:1] for y in years], "d string").select(strings.extract_year(F.col("d"))).collect()
    assert [r[0] for r in got] == [y[1] for y in years]
    names = spark.createDataFrame([("silva, j.; DOE-smith;;",), (None,)], "a string").select(strings.author_names(F.col("a")).alias("n")).collect()
    assert names[0].n == ["Silva J", "Doe Smith"] and names[1].n == []
    r = one(spark, strings.clean_doi(F.lit("DOI: 10.1/ x")), strings.csv_cell(F.lit('a"b')), strings.authors_string(F.array(F.lit("A"), F.lit("B"))), strings.page_bounds(F.lit("12-19")))
    assert r[0] == "10.1/x" and r[1] == '"a""b"' and r[2] == "A;B;" and tuple(r[3]) == (12, 19)


def test_math(spark):
    r = one(spark, mathx.epanechnikov(F.lit(0.0)), mathx.epanechnikov(F.lit(2.0)), mathx.gaussian(F.lit(0.0)), mathx.map_range(*[F.lit(x) for x in (5.0, 0.0, 10.0, 0.0, 1.0)]), mathx.interpolate(*[F.lit(x) for x in (0.0, 4.0, 0.25)]))
    assert r[0] == 0.75 and r[1] == 0 and math.isclose(r[2], 1 / math.sqrt(2 * math.pi)) and r[3] == 0.5 and r[4] == 1


def test_distances(spark):
    zero, a, b = (F.array(*[F.lit(float(x)) for x in v]) for v in ((0, 0), (3, 4), (-4, 3)))
    r = one(spark, vectors.euclidean(a, a), vectors.cosine(zero, zero), vectors.cosine(zero, a), vectors.cosine(a, b), vectors.extended_jaccard(a, a), vectors.extended_jaccard(zero, a), vectors.city_block(a, b), vectors.infinity_norm(a, b))
    assert [round(x, 9) for x in r] == [0, 0, 2, 1, 0.5, 1, 8, 7]
    assert vectors.warp(np.array([[0.0, 1, 2, 3]]), np.array([[0.0, 0, 1, 3]]))[0] == 1
    assert vectors.dissimilarity("nothing") is None
    rows = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0], [3.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [x[0] for x in rows.select(vectors.dynamic_time_warping(F.col("a"), F.col("b"))).collect()] == [0.0, 2.0, None]


def test_percentiles(spark):
    df = lambda v: spark.createDataFrame([(float(x),) for x in v], "v double")
    assert quantiles.legacy_percentiles(df([1, 2, 3, 4]), "v", [25, 75]) == [1.25, 3.75]
    assert quantiles.legacy_percentiles(df([7]), "v", [25]) == [7]
    assert quantiles.legacy_percentiles(df([]), "v", [25]) == [None]
    values = [random.Random(1).choice([0.0, 0.0, x / 7]) for x in range(500)]
    assert quantiles.median(df(values), "v") == pytest.approx(float(np.median(values)))


def test_running_total_against_python(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randint(0, 40)), float(rng.randint(1, 5))) for i in range(400)]
    got = prefix.running_total(spark.createDataFrame(rows, "id int, r double, a double"), "r", F.col("a"), "before", ties=["id"], pieces=7)
    so_far, want = 0.0, {}
    for i, r, a in sorted(rows, key=lambda x: (-x[1], x[0])):
        want[i], so_far = so_far, so_far + a
    assert {r.id: r.before for r in got.collect()} == want


def test_components_against_python(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(links, "a int, b int"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {n: root(n) for n in parent}
    assert components.connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_query_strings():
    assert text.build_query('c "a b"') == "(a <-> b)|c"
    assert text.build_query('"a b" c', "and") == "(a <-> b)&c"
    assert text.build_query("-x y", "and") == "!x&y"
    assert text.build_query("  ") is None and text.build_query(None) is None
    assert text.build_query("a b", "whatever") == "a|b"


def test_vectors_and_matching(spark):
    df = spark.createDataFrame([(1, "The deep", "learning of trees", None), (2, "trees", None, "")], "doc_id int, t string, k string, a string")
    v = df.select("doc_id", text.vector_map(text.document_vector(F.col("t"), F.col("k"), F.col("a"))).alias("v"))
    first = v.where("doc_id = 1").first().v
    assert {w: [(e.pos, e.weight) for e in es] for w, es in first.items()} == {"deep": [(2, "A")], "learning": [(3, "B")], "trees": [(5, "B")]}
    hit = lambda q: [r.doc_id for r in v.where(text.matches(q, F.col("v"))).orderBy("doc_id").collect()]
    assert hit("(deep <-> learning)") == [1] and hit("(learning <-> trees)") == [] and hit("trees&!deep") == [2] and hit("deep|trees") == [1, 2]
    assert text.porter("caresses") == "caress" and text.porter("relational") == "relat" and text.porter("hopping") == "hop" and text.porter("ponies") == "poni"


def test_upsert(spark):
    rows = spark.createDataFrame([(1, "d", None, "k1", 1), (2, "d", "t2", "k2", 2), (3, None, "x", None, 1), (4, None, "x", None, 2)], "doc_id int, doi string, title string, keywords string, at int")
    got = ingest.upsert_documents(rows, "at")
    want = {(1, "d", "t2", "k1"), (3, None, "x", None), (4, None, "x", None)}
    assert {tuple(r) for r in got.collect()} == want
    again = ingest.upsert_documents(got.withColumn("at", F.lit(1)), "at")
    assert {tuple(r) for r in again.select(got.columns).collect()} == want
    a = spark.createDataFrame([(5, "b")], "aut_id long, aut_name string")
    new = ingest.upsert_authors(a, spark.createDataFrame([("b",), ("zz",), ("aa",), (None,)], "aut_name string"))
    assert {tuple(r) for r in new.collect()} == {(5, "b"), (6, "aa"), (7, "zz")}


def test_references_and_merge(spark):
    parsed = spark.createDataFrame([(1, "d", [("d",), ("e",), (None,)]), (2, None, [("f",)])], "doc_id int, doi string, references array<struct<doi:string>>")
    assert {(r.doc_id, r.doi) for r in ingest.references_of(parsed).collect()} == {(1, "e"), (1, None), (2, "f")}


def test_pagerank(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 3)], "src int, dst int")
    step = {r.v: r.pr for r in graph.pagerank(edges, tolerance=0, max_iter=1).collect()}
    base = 0.15 / 4
    assert step[3] == pytest.approx(base + 0.85 * 0.25 * 2.5) and step[2] == pytest.approx(base + 0.85 * 0.125) and sum(step.values()) < 1
    cycle = graph.pagerank(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int"))
    assert all(r.pr == pytest.approx(1 / 3) for r in cycle.collect())
    assert graph.pagerank(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_author_edges(spark):
    cites = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 1, None)], "id long, doc_id long, ref_id long")
    links = spark.createDataFrame([(1, 1, 10), (2, 1, 11), (3, 2, 10), (4, 2, 12), (5, 2, None)], "id long, doc_id long, aut_id long")
    got = {(r.src, r.dst): r.weight for r in graph.author_edges(cites, links).collect()}
    assert got == {(10, 10): 1, (10, 12): 1, (11, 10): 1, (11, 12): 1}


def test_term_matrix(spark):
    docs = spark.createDataFrame([(1, [("a", 2), ("b", 1)]), (2, [("a", 1)])], "doc_id int, freqs array<struct<word:string,nentry:int>>")
    words = spark.createDataFrame([("a", 2), ("b", 1)], "word string, ndoc long")
    m = {(r.doc_id, r.word): r.weight for r in termmatrix.frequency_matrix(docs, words, 2, 3).collect()}
    assert m[1, "a"] == pytest.approx(1 + 2 * math.log(2)) and m[2, "a"] == pytest.approx(1)
    unit = termmatrix.normalise_rows(termmatrix.frequency_matrix(docs, words, 2, 3)).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in unit)


def test_quadtree_against_insertion(spark):
    rng = random.Random(4)
    pts = [(i, rng.choice([rng.uniform(-1, 1), 0.3 + rng.uniform(0, 0.01), 1.0]), rng.uniform(-1, 1), rng.random()) for i in range(300)]
    depth, cap = 6, 5
    top = 2**depth - 1
    keys = {i: (min(int((x + 1) * 2**depth / 2), top), min(int((y + 1) * 2**depth / 2), top)) for i, x, y, _ in pts}
    leaves = {}

    def split(members, d):
        if len(members) <= cap or d == depth:
            leaves.update({m: d for m in members})
            return
        for q in range(4):
            split([m for m in members if (keys[m][0] >> depth - d - 1 & 1) * 2 + (keys[m][1] >> depth - d - 1 & 1) == q], d + 1)

    for q in range(4):
        split([m for m in keys if (keys[m][0] >> depth - 1 & 1) * 2 + (keys[m][1] >> depth - 1 & 1) == q], 1)
    df = spark.createDataFrame(pts, "doc_id int, x double, y double, rank double")
    got = spatial.assign_leaves(df, depth, cap).collect()
    assert {r.doc_id: r.leaf_depth for r in got} == leaves
    nodes = {r.node_id: r for r in spatial.quadtree_nodes(df, depth, cap).collect()}
    assert sum(n.n for n in nodes.values() if n.isleaf) == 300 and all(n.n <= cap or n.depth == depth for n in nodes.values() if n.isleaf)
    assert all(n.parent_id in nodes for n in nodes.values() if n.parent_id is not None) and {r.leaf_id for r in got} <= set(nodes)
    assert all(sum(c.parent_id == n.node_id for c in nodes.values()) == 4 for n in nodes.values() if not n.isleaf)


def test_budget_and_radius(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 3.0), (2, 1.0, 1.0, 2.0), (3, 0.2, 0.0, 2.0), (4, 0.0, 0.1, None)], "doc_id int, x double, y double, rank double")
    assert {r.doc_id for r in spatial.rank_budget(df, 4.0).collect()} == {1, 2}
    assert {r.doc_id for r in spatial.in_radius(df, 0, 0, 0.2).collect()} == {1, 3}
    flat = spatial.normalise(spatial.mark_outliers(df.withColumn("y", F.lit(2.0))))
    assert {r.y for r in flat.collect()} == {0.0} and flat.agg(F.min("x"), F.max("x")).first() == (-1.0, 1.0)


def test_density(spark):
    rng = random.Random(5)
    pts = [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(200)]
    df, box, bw = spark.createDataFrame(pts, "x double, y double"), (-1.0, -1.0, 1.0, 1.0), 0.21
    width, height, sx, sy = density.grid_shape(box, bw)
    want = {}
    for i in range(height):
        for j in range(width):
            px, py = -1 + sx / 2 + i * sx, -1 + sy / 2 + j * sy
            d = [math.hypot(x - px, y - py) for x, y in pts]
            if any(v < bw for v in d):
                want[i, j] = sum(0.75 * (1 - (v / bw) ** 2) for v in d if v < bw)
    grid = density.density_grid(df, box, bw)
    got = {(r.i, r.j): r.density for r in grid.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    none = density.merge_grids(grid, density.density_grid(df, box, bw, sign=-1))
    assert none.agg(F.max(F.abs("density"))).first()[0] < 1e-9
    assert density.bandwidth(df.limit(0)) == 0 and density.density_grid(df, box, 0.0).count() == 0


def test_projection(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 5))
    for n in (0, 1, 2, 3, 4):
        assert projection.fastmap(projection.pairwise(x[:n])).shape == (n, 2)
    assert not projection.fastmap(np.zeros((5, 5))).any()
    places = projection.idmap(x, 5)
    assert places.min() >= 0 and places.max() <= 1
    assert np.allclose(projection.affine_maps(x[3:4], x, places, 10), places[3])
    probe = rng.normal(size=(6, 5))
    for use in (4, 40):
        for row, got in zip(probe, projection.affine_maps(probe, x, places, use)):  # one row at a time, as the map is defined
            near = np.argsort(((x - row) ** 2).sum(axis=1), kind="stable")[:use]
            w = 1 / ((x[near] - row) ** 2).sum(axis=1)
            p, q = w @ x[near] / w.sum(), w @ places[near] / w.sum()
            u, _, vt = np.linalg.svd((np.sqrt(w)[:, None] * (x[near] - p)).T @ (np.sqrt(w)[:, None] * (places[near] - q)), full_matrices=False)
            assert np.allclose(got, (row - p) @ (u @ vt) + q)
    line = projection.nearest_neighbour_projection(projection.pairwise(np.array([[0.0], [1.0], [3.0]])))
    assert np.hypot(*(line[1] - line[0])) == pytest.approx(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    assert projection.lamp(rows).count() == 40 and projection.lamp(rows.limit(0)).count() == 0
    assert projection.control_points(rows, 7, "REPRESENTATIVE").count() == 7


def test_author_ranks_are_settled(spark, tmp_path):
    """A chain of ten papers that cite the next one, each by an author of its own: ranks reach its end."""
    spark.createDataFrame([(i, i, i + 1) for i in range(10)], "id long, doc_id long, ref_id long").write.parquet(str(tmp_path / "citations.parquet"))
    spark.createDataFrame([(i, i, 100 + i) for i in range(11)], "id long, doc_id long, aut_id long").write.parquet(str(tmp_path / "document_authors.parquet"))
    got = {r.v: r.pr / 1e6 for r in queries()["author_pagerank"](spark, str(tmp_path)).collect()}
    want, value = {}, 0.0
    for i in range(11):
        value = 0.15 / 11 + 0.85 * value
        want[100 + i] = value
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("name", ["fastmap", "idmap", "nearest_neighbour_projection"])
def test_every_row_gets_a_place(spark, tmp_path, name):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2500, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.id: (r.x, r.y) for r in queries()[name](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(2500)) and np.isfinite(list(got.values())).all()
    ids = sorted(r.id for r in projection.control_points(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features")), 50, "RANDOM").collect())
    control = x[ids].astype(np.float32).astype(float)
    d = projection.pairwise(control)
    placed = {"fastmap": lambda: projection.fastmap(d), "idmap": lambda: projection.idmap(control), "nearest_neighbour_projection": lambda: projection.normalise_keeping_aspect(projection.nearest_neighbour_projection(d))}[name]()
    assert np.allclose([got[i] for i in ids], placed)


def test_clusters(spark):
    rows = [(i, [float(i % 3 * 10 + i * 0.01), float(i % 3)]) for i in range(60)]
    data, centres = cluster.bisecting_kmeans(spark.createDataFrame(rows, "id int, features array<double>"), 3)
    groups = {}
    for r in data.collect():
        groups.setdefault(r.cluster, set()).add(r.id % 3)
    assert len(centres) == 3 and all(len(g) == 1 for g in groups.values())
    assert cluster.medoids(data, centres).count() == 3


def test_clusters_beside_copies(spark):
    """A cluster that cannot be split does not keep the others from being split."""
    split = lambda vectors, k: cluster.bisecting_kmeans(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id int, features array<double>"), k, iterations=5)
    copies = [[0.0, 0.0]] * 40 + [[100.0 + 10 * (i % 4), 50.0 * (i % 2)] for i in range(32)]
    data, centres = split(copies, 5)
    assert len(centres) == 5 and {r.cluster for r in data.collect()} == set(range(5))
    data, centres = split([[1.0, 1.0]] * 45 + [[5.0, 5.0]] * 5, 3)
    assert len(centres) == 2 and sorted(r["count"] for r in data.groupBy("cluster").count().collect()) == [5, 45]
    for n in range(11, 14):
        assert len(split([[float(i), 0.0] for i in range(n)], 2)[1]) == 2


def test_packed_values(spark):
    lists = [f"{a} {b}; {c}, {d}" for a, b, c, d in (("Ann", "Lee", "Roe", "Jane"), ("Bob", "Ray", "Roe", "Jane"), ("Ann", "Lee", "Doe", "Jim"))] * 5
    rows = [(i, None, s) for i, s in enumerate(lists)] + [
        (100, 'a | "b, c" | | d;', "Roe, Jane"), (101, "x / y/z /", "Ann Lee, Bob Ray and Kim Poe"), (102, "", "   "), (103, None, None), (104, "'it, is', lone", '"Roe, Jane", Ann Lee'), (105, "z" * 5000 + ";" + "y" * 5000, "Ann Lee"),
    ]
    got = {}
    for r in packed.unpack_values(spark.createDataFrame(rows, "doc_id long, keywords string, authors string")).collect():
        got.setdefault((r.doc_id, r.field), []).append((r.pos, r.val))
    value = lambda *k: [v for _, v in sorted(got[k])]
    assert value(100, "keywords") == ["a", "b, c", "d"] and value(100, "authors") == ["Roe, Jane"]
    assert value(101, "keywords") == ["x", "y/z"] and value(101, "authors") == ["Ann Lee", "Bob Ray", "Kim Poe"]
    assert value(104, "keywords") == ["it, is", "lone"] and value(104, "authors") == ["Roe, Jane", "Ann Lee"]
    assert value(0, "authors") == ["Ann Lee", "Roe, Jane"] and value(105, "keywords") == ["z" * 5000, "y" * 5000]
    assert not any(k[0] in (102, 103) for k in got)
    assert packed.unpack_values(spark.createDataFrame([], "doc_id long, keywords string, authors string")).count() == 0
    assert {k[0] for k in got if k[1] == "authors"} - {r.doc_id for r in packed.lists_only(packed.unpack_values(spark.createDataFrame(rows, "doc_id long, keywords string, authors string"))).where("field = 'authors'").collect()} == {100, 105}


def test_sources(spark, tmp_path):
    page = '<meta name="Citation_Title" content="T"><meta name="dc.creator" content="A; B"><meta name="author" content="C"><div class="abstract">Some <b>text</b></div>'
    got = documents_in.page_fields(page)
    assert got["title"] == "T" and got["authors"] == "A;B;C" and got["abstract"] == "Some text" and documents_in.page_fields(None)["title"] is None
    rows = spark.createDataFrame([("a", [1.0, 2.5], 1.0), ("b", [0.0, -3.0], 0.0)], "id string, features array<double>, klass double")
    matrix_text.write_matrix(rows, str(tmp_path / "m"), "DY", 2)
    assert {(r.id, tuple(r.features), r.klass) for r in matrix_text.read_matrix(spark, str(tmp_path / "m")).collect()} == {("a", (1.0, 2.5), 1.0), ("b", (0.0, -3.0), 0.0)}
    (tmp_path / "s.data").write_text("SN\n2\n5\nv1;v2\n7;0:1.5;4:2\n8;2:1\n")
    assert {r.id: r.cells for r in matrix_text.read_matrix(spark, str(tmp_path / "s.data")).collect()} == {"7": {0: 1.5, 4: 2.0}, "8": {2: 1.0}}
    (tmp_path / "bad.data").write_text("DN\n3\n2\n7;1;2\n")
    with pytest.raises(ValueError):
        matrix_text.read_matrix(spark, str(tmp_path / "bad.data"))
    lines = spark.createDataFrame([('[{"title":"T","type":"journal-article","authors":[{"first_name":"A","last_name":"B"}],"identifiers":{"doi":"d"}}]',), ("no",)], "json string")
    assert [(r.title, r.type, r.authors, r.publication_date) for r in documents_in.catalogue_records(lines).collect()] == [("T", "article", "A B", 0)]


def test_numbering_and_budget_of_a_hot_value(spark):
    """Nine tenths of the rows share one rank, and all names begin alike."""
    rows = [(i, 0.5 if i % 10 else 1.0 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, rank double")
    for budget in (0.0, 1.5, 60.0, 2125.3, 1e9):
        want, total = set(), 0.0
        for i, r in sorted(rows, key=lambda x: (-x[1], x[0])):
            if total < budget:
                want.add(i)
            total += r
        assert {r.doc_id for r in spatial.rank_budget(df, budget).collect()} == want
    names = [f"University of {i % 100:04d}" for i in range(200)]
    got = ingest.upsert_authors(spark.createDataFrame([(7, names[3])], "aut_id long, aut_name string"), spark.createDataFrame([(n,) for n in names], "aut_name string"))
    assert [(r.aut_id, r.aut_name) for r in got.orderBy("aut_id").collect()] == [(7, names[3])] + [(8 + k, n) for k, n in enumerate(sorted(set(names) - {names[3]}))]
    assert prefix.numbered(df.limit(0), "doc_id", "n").count() == 0


def test_stream_upserts_once(spark, tmp_path):
    """Rows delivered twice in one batch and again in the next stay one row; only touched buckets get a new version."""
    schema = "doc_id long, doi string, title string, at long"
    store = str(tmp_path / "store")
    one = [(1, "a", None, 1), (1, "a", None, 1), (2, None, "x", 2), (2, None, "x", 2), (3, "b", "B", 3)]
    incremental.upsert_batch(spark.createDataFrame(one, schema), 0, store, "at")
    incremental.upsert_batch(spark.createDataFrame(one + [(4, "a", "A", 9)], schema), 1, store, "at")
    incremental.upsert_batch(spark.createDataFrame(one + [(4, "a", "A", 9)], schema), 1, store, "at")
    got = incremental.stored(spark, store).orderBy("doc_id").collect()
    assert [(r.doc_id, r.doi, r.title) for r in got] == [(1, "a", "A"), (2, None, "x"), (3, "b", "B")]
    for n in range(2, 5):
        incremental.upsert_batch(spark.createDataFrame([(5, "c", "C", 11)], schema), n, store, "at")
    bucket = [r for r in incremental.stored(spark, store).collect() if r.doi == "c"][0]._bucket
    assert {r._version for r in spark.read.parquet(store).where(f"_bucket = {bucket}").collect()} <= {3, 4}
    assert incremental.stored(spark, store).count() == 4


def test_cited_records_are_stored_first(spark):
    docs = spark.createDataFrame([(1, "a", "A"), (2, "b", "B")], "doc_id long, doi string, title string")
    refs = spark.createDataFrame([(1, "b", "B"), (1, "z", "Z"), (2, "z", "Z"), (2, None, "?"), (1, "a", "A")], "doc_id long, doi string, title string")
    stored, links = ingest.cite(spark.createDataFrame([(1, 2)], "doc_id long, ref_id long"), docs, refs)
    assert {tuple(r) for r in stored.collect()} == {(1, "a", "A"), (2, "b", "B"), (3, "z", "Z")}
    assert {(r.doc_id, r.ref_id) for r in links.collect()} == {(1, 3), (2, 3)}


def test_small_functions(spark):
    r = one(spark, strings.sanitize(F.lit("smith [ed.]")), strings.container_of(F.lit(None), F.lit("b"), F.lit("e")), strings.container_of_reference(F.lit(None), F.lit("e"), F.lit("b")), strings.pages_of(F.lit(None), F.lit("1"), F.lit("9")), strings.year_of(F.lit("x"), F.lit("1999")), mathx.hypot(F.lit(3e200), F.lit(4e200)))
    assert r[0] == "Smith Ed" and r[1] == "b" and r[2] == "e" and r[3] == "1-9" and r[4] == 1999 and r[5] == pytest.approx(5e200)
    a, b = (F.array(*[F.lit(x) for x in v]) for v in ((0.0, 1.0), (0.0, 1.000001)))
    r = one(spark, vectors.zero_share(a), vectors.is_null_vector(a), vectors.nearly_equal(a, b), text.trigrams(F.lit("Cat")))
    assert r[0] == 0.5 and not r[1] and r[2] and r[3] == ["  c", " ca", "at ", "cat"]
    assert text.vector_of(("The cat", None, "A cat of cats"), text.porter) == {"cat": [(2, "A"), (4, "C"), (6, "C")]}


def test_writers(spark, tmp_path):
    matrix = spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.0), (2, "b", 2.0)], "doc_id long, word string, weight double")
    termmatrix.write_term_table(matrix, str(tmp_path / "t"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [tuple(r) for r in back] == [("1", "0.5", "1.0"), ("2", "0.0", "2.0")]
    dense = termmatrix.to_dense(matrix, ["a", "b"])
    assert {(r.doc_id, r.word, r.weight) for r in termmatrix.to_sparse(dense, ["a", "b"]).collect()} == {tuple(r) for r in matrix.collect()}
    places = spark.createDataFrame([(1, 0.25, 0.5), (2, 1.0, 0.0)], "id long, x double, y double")
    matrix_text.write_projection(places, str(tmp_path / "p"))
    assert {r.id: list(r.features) for r in matrix_text.read_matrix(spark, str(tmp_path / "p")).collect()} == {"1": [0.25, 0.5], "2": [1.0, 0.0]}
    grid = density.density_grid(places, (0.0, 0.0, 1.0, 1.0), 0.1)
    density.write_grid(grid, str(tmp_path / "g"))
    assert spark.read.csv(str(tmp_path / "g")).count() == grid.count() > 0


def test_control_points(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0, 0.0]) for i in range(60)], "id long, features array<double>")
    for choice in ("RANDOM", "KMEANS", "REPRESENTATIVE"):
        assert projection.control_points(rows, 10, choice).count() == 10
    assert projection.control_points(rows, 1, "REPRESENTATIVE").count() == 3
    assert {r.id for r in projection.control_points(rows, 10, "RANDOM").collect()} != set(range(10))
    with pytest.raises(ValueError):
        projection.lamp(rows, 5000)


def test_sparse_products(spark):
    """Repeated ids and words, weights that cancel out, missing words, several blocks, common and rare words; pairs are never shuffled."""
    draw = random.Random(5)
    lines = [(i, [draw.choice(["x", "y", "z", *map(str, range(300)), None]) for _ in range(12)], [draw.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(12)]) for i in [*range(200), 7, 50, 50]]
    lines += [(300, ["p", "q"], [1.0, 1.0]), (301, ["p", "q"], [1.0, -1.0]), (302, [], []), (303, None, None), (None, ["x"], [1.0])]
    rows = spark.createDataFrame(lines, "doc_id long, words array<string>, weights array<double>")
    cells = {}
    for i, words, weights in lines:
        for w, v in zip(words or [], weights or []):
            cells.setdefault(i, {})[w] = cells.get(i, {}).get(w, 0.0) + v
    cells = {i: {w: v for w, v in r.items() if v} for i, r in cells.items() if i is not None}
    want = {(a, b): sum(u * cells[b][w] for w, u in cells[a].items() if w and w in cells[b]) for a in cells if a % 50 == 0 for b in cells if any(w and w in cells[b] for w in cells[a])}
    assert want[300, 301] == 0.0
    for block_rows in (2, 4096):
        pairs = termmatrix.sparse_products(rows.where("doc_id % 50 = 0"), rows, block_rows=block_rows)
        got = pairs.collect()
        assert len(got) == len(want) and {(r.a, r.b): round(r.value, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert not termmatrix.sparse_products(rows.where("doc_id < 0"), rows).collect()


def test_sparse_cosine(spark, tmp_path):
    """Against the SQL: repeated and missing words, rows of one id, words used no times; one shuffle, of the documents."""
    import duckdb

    from scholarium.queries import oracle_sql

    freqs = {50: [("a", 2), ("b", 1), (None, 3)], 100: [("a", 1), ("a", 4), ("c", 0)], 3: [("a", 1), ("c", 5), ("d", None)], 4: [("c", 1)], 5: None, 6: [], 7: [("b", 2), (None, 1)]}
    rows = [*freqs.items(), (7, [("a", 1)])]
    spark.createDataFrame(rows, "doc_id long, freqs array<struct<word: string, nentry: int>>").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries()["sparse_cosine"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in df.select("a", "b", "distance").collect()) == sorted(c.sql(f"SELECT a, b, distance FROM ({oracle_sql()['sparse_cosine']})").fetchall())
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
