"""Registry of the core queries and the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholarium.functions import mathx, strings, vectors
from scholarium.operators import cluster, density, graph, ingest, packed, projection, spatial, termmatrix, text
from scholarium.operators.nearest import against_all, nearest
from scholarium.operators.prefix import numbered
from scholarium.operators.quantiles import legacy_percentiles
from scholarium.plans import service
from scholarium.plans.lineage import shared_folder
from scholarium.sources import documents_in
from scholarium.sources.tables import TABLES, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def tables_of(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in TABLES}


def points_of(spark: SparkSession, d: str, within: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(doc_id, x, y, rank), one row a document that has a place; a missing rank is null.

    Rows delivered twice are identical, so a box (x1, y1, x2, y2) is looked at first and reaches the scan.
    """
    rows = table(spark, d, "documents_data").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    if within is not None:
        rows = rows.where(F.col("x").between(within[0], within[2]) & F.col("y").between(within[1], within[3]))
    return rows.groupBy("doc_id").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.max(F.when(~F.isnan("rank"), F.col("rank"))).alias("rank"))


PTS = "pts AS (SELECT doc_id, any_value(x) AS x, any_value(y) AS y, max(CASE WHEN NOT isnan(rank) THEN rank END) AS rank FROM documents_data WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) GROUP BY doc_id)"
DATA = "dat AS (SELECT doc_id, any_value(x) AS x, any_value(y) AS y, any_value(rank) AS rank FROM documents_data WHERE rank IS NOT NULL AND NOT isnan(rank) GROUP BY doc_id)"
CITES = "cites AS (SELECT DISTINCT doc_id AS src, ref_id AS dst FROM citations WHERE doc_id IS NOT NULL AND ref_id IS NOT NULL AND doc_id <> ref_id)"
LINKS = "links AS (SELECT DISTINCT doc_id, aut_id FROM document_authors WHERE doc_id IS NOT NULL AND aut_id IS NOT NULL)"


# Packed fields -----------------------------------------------------------------------------------


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.found(table(spark, d, "documents"))


# Search ------------------------------------------------------------------------------------------


def _search(spark: SparkSession, d: str, **request) -> DataFrame:
    return service.search(tables_of(spark, d), **request).documents.select("doc_id", F.round("rank", 6).alias("rank"))


def _search_sql(where: str, extra: str = "", limit: str = "LIMIT 100") -> str:
    return f"WITH {DATA} SELECT doc_id, round(rank, 6) AS rank FROM documents JOIN dat USING (doc_id) WHERE enabled AND {where} {extra} ORDER BY dat.rank DESC, doc_id {limit}"


def _has(word: str) -> str:
    return f"coalesce(list_contains(map_keys(tsv), '{word}'), FALSE)"


_PHRASE = "coalesce(len(list_filter(tsv['approach'], lambda e: list_contains(list_transform(tsv['rest'], lambda f: f.pos), e.pos + 1))) > 0, FALSE)"


@query(_search_sql(f"({_has('sediment')} OR {_has('household')})"))
def search_or(spark, d):
    return _search(spark, d, terms="sediment household", operator="or")


@query(_search_sql(f"{_has('sample')} AND {_has('depth')}"))
def search_and(spark, d):
    return _search(spark, d, terms="sample depth", operator="and")


@query(_search_sql(_PHRASE))
def search_phrase(spark, d):
    return _search(spark, d, terms='"approach rest"')


@query(_search_sql(f"tsv IS NOT NULL AND {_has('depth')} AND NOT {_has('household')}"))
def search_not(spark, d):
    return _search(spark, d, terms="depth -household", operator="and")


@query(_search_sql("TRUE", limit="LIMIT 100 OFFSET 100"))
def search_all_second_page(spark, d):
    return _search(spark, d, page=1)


@query(_search_sql("publication_date >= 1990 AND publication_date <= 2015 AND doc_id IN (SELECT doc_id FROM document_authors JOIN authors USING (aut_id) WHERE list_contains(regexp_extract_all(lower(aut_name), '[\\p{L}\\p{N}]+'), 'elizabeth'))"))
def search_advanced_author_year(spark, d):
    return _search(spark, d, author="elizabeth", year_start=1990, year_end=2015)


@query(_search_sql(f"{_has('depth')} AND x BETWEEN -0.5 AND 0.5 AND y BETWEEN -0.25 AND 0.75"))
def zoom_search(spark, d):
    return _search(spark, d, terms="depth", start=(0.5, 0.75), end=(-0.5, -0.25))


@query(f"WITH {DATA}, m AS (SELECT doc_id, x, y, row_number() OVER (ORDER BY rank DESC, doc_id) AS k FROM documents JOIN dat USING (doc_id) WHERE enabled AND {_has('depth')}) SELECT doc_id, round(x, 6) AS x, round(y, 6) AS y FROM m WHERE k > 100")
def density_points_tail(spark, d):
    t = tables_of(spark, d)
    found = service.simple_documents(t["documents"], t["documents_data"]).where(text.matches("depth", F.col("tsv")))
    return service.rest_after(found, 100).select("doc_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {DATA}, shown AS (SELECT doc_id, words FROM documents JOIN dat USING (doc_id) WHERE enabled ORDER BY dat.rank DESC, doc_id LIMIT 100), w AS (SELECT unnest(words[1:10]) AS w FROM shown) SELECT w.word AS text, CAST(sum(w.nentry) AS BIGINT) AS size FROM w WHERE length(w.word) > 2 OR lower(w.word) IN ('2d', '3d') GROUP BY 1")
def word_cloud(spark, d):
    return service.word_cloud(service.search(tables_of(spark, d)).documents)


@query("SELECT doc_id, '\"' || replace(coalesce(doi, ''), '\"', '\"\"') || '\",\"' || replace(coalesce(title, ''), '\"', '\"\"') || '\",\"' || replace(coalesce(authors, ''), '\"', '\"\"') || '\",\"' || coalesce(CAST(publication_date AS VARCHAR), '') || '\",\"' || replace(coalesce(bibtex, ''), '\"', '\"\"') || '\"' AS line FROM documents WHERE enabled")
def csv_export(spark, d):
    return service.export_lines(table(spark, d, "documents"))


@query("SELECT count(*) AS n FROM documents")
def count_documents(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DATA} SELECT doc_id, round(rank, 6) AS rank FROM documents JOIN dat USING (doc_id) WHERE enabled AND doc_id IN (SELECT doc_id FROM citations WHERE ref_id = 7)")
def documents_by_ids(spark, d):
    ids = table(spark, d, "citations").where("ref_id = 7").select("doc_id").distinct()
    t = tables_of(spark, d)
    return service.simple_documents(t["documents"], t["documents_data"]).join(ids, "doc_id", "left_semi").select("doc_id", F.round("rank", 6).alias("rank"))


# Text statistics ---------------------------------------------------------------------------------

_STOP = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"
_TOKENS = "SELECT doc_id, unnest(list_concat(list_concat(regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}]+'), regexp_extract_all(lower(coalesce(keywords, '')), '[\\p{L}\\p{N}]+')), regexp_extract_all(lower(coalesce(abstract, '')), '[\\p{L}\\p{N}]+'))) AS word FROM documents"


@query(f"WITH t AS ({_TOKENS}), c AS (SELECT doc_id, word, count(*) AS n FROM t WHERE word NOT IN {_STOP} GROUP BY ALL) SELECT doc_id, string_agg(word || ':' || n, ' ' ORDER BY -n, word) AS words FROM c GROUP BY doc_id")
def doc_word_freqs(spark, d):
    """Word counts of title, keywords and abstract without stemming."""
    said = F.concat(*[text.tokens(F.col(c)) for c in ("title", "keywords", "abstract")])
    words = table(spark, d, "documents").select("doc_id", F.explode(said).alias("word")).where(~F.col("word").isin(*text.STOP_WORDS))
    return text.word_counts(words, "doc_id", "word").select("doc_id", F.array_join(F.transform("words", lambda e: F.concat_ws(":", e["word"], e["nentry"].cast("string"))), " ").alias("words"))


@query("WITH e AS (SELECT unnest(map_entries(tsv)) AS e FROM documents) SELECT e.key AS word, count(*) AS ndoc, CAST(sum(len(e.value)) AS BIGINT) AS nentry FROM e GROUP BY 1")
def ts_stat(spark, d):
    return text.term_statistics(table(spark, d, "documents"))


@query("WITH e AS (SELECT unnest(map_entries(tsv)) AS e FROM documents), s AS (SELECT e.key AS word, count(*) AS ndoc, CAST(sum(len(e.value)) AS BIGINT) AS nentry FROM e GROUP BY 1) SELECT * FROM s WHERE ndoc > 5 AND ndoc < 200 AND nentry > 10")
def vocab_pruned(spark, d):
    return text.pruned_vocabulary(text.term_statistics(table(spark, d, "documents")), ndoc=(5, 200), nentry=(10, float("inf")))


@query("WITH e AS (SELECT doc_id, unnest(map_entries(tsv)) AS e FROM documents), p AS (SELECT doc_id, e.key AS word, unnest(e.value) AS q FROM e) SELECT q.weight AS weight, count(*) AS n, count(DISTINCT word) AS words FROM p GROUP BY 1")
def vector_places(spark, d):
    rows = text.postings(table(spark, d, "documents")).select("word", F.explode("positions").alias("q"))
    return rows.groupBy(F.col("q.weight").alias("weight")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("word").alias("words"))


@query()
def stemmed_vectors(spark, d):
    """Stemmed words of title, keywords and abstract: documents and places."""
    rows = text.build_vectors(table(spark, d, "documents").withColumn("_english", F.lit("english")), language=F.col("_english"))
    return rows.select(F.explode("tsv").alias("word", "places")).groupBy("word").agg(F.count(F.lit(1)).alias("ndoc"), F.sum(F.size("places")).alias("nentry"))


def _weights(spark, d, number, kind="freqs"):
    docs = table(spark, d, "documents")
    n = docs.count()
    if kind == "freqs":
        words = docs.select("doc_id", F.explode("freqs").alias("e")).groupBy(F.col("e.word").alias("word")).agg(F.countDistinct("doc_id").alias("ndoc"))
        m = termmatrix.frequency_matrix(docs, words.where("ndoc > 2"), n, number)
    else:
        m = termmatrix.vector_matrix(docs, text.term_statistics(docs).where("ndoc > 2"), n, number)
    return m.select("doc_id", "word", F.round("weight", 6).alias("weight"))


_SCHEME_SQL = {1: "f * ln(n / (1 + ndoc))", 2: "(1 + log10(f)) * log10(1 + ndoc / n)", 3: "1 + ln(f)", 4: "f * log2(ndoc / n)"}


def _weights_sql(number: int, kind: str = "freqs") -> str:
    if kind == "freqs":
        terms = "SELECT doc_id, e.word AS word, CAST(e.nentry AS DOUBLE) AS f FROM (SELECT doc_id, unnest(freqs) AS e FROM documents)"
        plus = " + ln(f)"
    else:
        terms = "SELECT doc_id, word, sum(CASE q.weight WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.4 WHEN 'C' THEN 0.2 ELSE 0.1 END) AS f FROM (SELECT doc_id, e.key AS word, unnest(e.value) AS q FROM (SELECT doc_id, unnest(map_entries(tsv)) AS e FROM documents)) GROUP BY ALL"
        plus = ""
    return f"WITH t AS ({terms}), v AS (SELECT word, CAST(count(DISTINCT doc_id) AS DOUBLE) AS ndoc FROM t GROUP BY 1 HAVING ndoc > 2), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents), w AS (SELECT doc_id, word, {_SCHEME_SQL[number]}{plus} AS weight FROM t JOIN v USING (word), c) SELECT doc_id, word, round(weight, 6) AS weight FROM w WHERE weight <> 0"


for _k in _SCHEME_SQL:
    query(_weights_sql(_k), f"tfidf_scheme{_k}")(lambda spark, d, k=_k: _weights(spark, d, k))
query(_weights_sql(2, "tsv"), "tfidf_vectors")(lambda spark, d: _weights(spark, d, 2, "tsv"))


@query("WITH t AS (SELECT doc_id, unnest(freqs) AS e FROM documents), w AS (SELECT doc_id, e.word AS word, 1 + 2 * ln(e.nentry) AS weight FROM t WHERE e.nentry > 0) SELECT count(DISTINCT doc_id) AS n_rows, count(DISTINCT word) AS n_terms, count(*) AS n_cells, round((1 - count(*) / (count(DISTINCT doc_id) * count(DISTINCT word))) * 100, 6) AS zero_percent, max(length(word)) AS longest_term FROM w")
def matrix_sparsity(spark, d):
    docs = table(spark, d, "documents")
    words = docs.select(F.explode("freqs").alias("e")).select(F.col("e.word").alias("word")).distinct().withColumn("ndoc", F.lit(1))
    m = termmatrix.frequency_matrix(docs, words, 1, 3)
    return termmatrix.sparsity(m).withColumn("zero_percent", F.round("zero_percent", 6))


# Graph -------------------------------------------------------------------------------------------


def _rank_sql(steps: int) -> str:
    parts = [CITES, "verts AS (SELECT src AS v FROM cites UNION SELECT dst FROM cites)", "deg AS (SELECT src, count(*) AS k FROM cites GROUP BY src)", "n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM verts)", "r0 AS (SELECT v, 1 / n AS pr FROM verts, n)"]
    for i in range(1, steps + 1):
        parts.append(f"f{i} AS (SELECT c.dst AS v, sum(r.pr / d.k * 0.85) AS f FROM cites c JOIN deg d ON c.src = d.src JOIN r{i - 1} r ON r.v = c.src GROUP BY c.dst)")
        parts.append(f"r{i} AS (SELECT verts.v, (1 - 0.85) / n + coalesce(f, 0) AS pr FROM verts CROSS JOIN n LEFT JOIN f{i} ON f{i}.v = verts.v)")
    return f"WITH {', '.join(parts)} SELECT v, round(pr * 1e6, 4) AS pr FROM r{steps}"


def _ranked(spark, d, steps):
    ranks = graph.pagerank(graph.citation_edges(table(spark, d, "citations")), tolerance=0, max_iter=steps)
    return ranks.select("v", F.round(F.col("pr") * 1e6, 4).alias("pr"))


query(_rank_sql(1), "pagerank_step")(lambda spark, d: _ranked(spark, d, 1))
query(_rank_sql(10), "pagerank_k10")(lambda spark, d: _ranked(spark, d, 10))


def _settled_sql(edges: str, tolerance: float = 1e-7, most: int = 50) -> str:
    """Ranks of (src, dst, w) at the first step that moves less than the tolerance."""
    parts = [edges, "verts AS MATERIALIZED (SELECT src AS v FROM ed UNION SELECT dst FROM ed)", "deg AS MATERIALIZED (SELECT src, sum(w) AS k FROM ed GROUP BY src)", "n AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM verts)", "r0 AS MATERIALIZED (SELECT v, 1 / n AS pr FROM verts, n)"]
    for i in range(1, most + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT verts.v, (1 - 0.85) / n + coalesce(f, 0) AS pr FROM verts CROSS JOIN n LEFT JOIN (SELECT c.dst AS v, sum(r.pr * c.w / d.k * 0.85) AS f FROM ed c JOIN deg d ON c.src = d.src JOIN r{i - 1} r ON r.v = c.src GROUP BY c.dst) f ON f.v = verts.v)")
    moved = " UNION ALL ".join(f"SELECT {i} AS i, sqrt(sum((a.pr - b.pr) * (a.pr - b.pr))) AS moved FROM r{i} a JOIN r{i - 1} b USING (v)" for i in range(1, most + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS i, v, pr FROM r{i}" for i in range(1, most + 1))
    return f"WITH {', '.join(parts)}, m AS ({moved}), s AS (SELECT coalesce(min(i) FILTER (WHERE moved < {tolerance}), {most}) AS i FROM m), e AS ({every}) SELECT v, round(pr * 1e6, 3) AS pr FROM e JOIN s USING (i)"


@query(_settled_sql(f"{CITES}, ed AS MATERIALIZED (SELECT src, dst, 1.0 AS w FROM cites)"))
def pagerank_settled(spark, d):
    return graph.pagerank(graph.citation_edges(table(spark, d, "citations"))).select("v", F.round(F.col("pr") * 1e6, 3).alias("pr"))


@query(_settled_sql(f"{CITES}, {LINKS}, ed AS MATERIALIZED (SELECT a.aut_id AS src, b.aut_id AS dst, CAST(count(*) AS DOUBLE) AS w FROM cites c JOIN links a ON a.doc_id = c.src JOIN links b ON b.doc_id = c.dst GROUP BY ALL)"))
def author_pagerank(spark, d):
    edges = graph.author_edges(table(spark, d, "citations"), table(spark, d, "document_authors"))
    return graph.pagerank(edges).select("v", F.round(F.col("pr") * 1e6, 3).alias("pr"))


def _jump_sql(steps: int, jump: float = 0.15) -> str:
    parts = [CITES, "verts AS MATERIALIZED (SELECT src AS v FROM cites UNION SELECT dst FROM cites)", "deg AS MATERIALIZED (SELECT src, count(*) AS k FROM cites GROUP BY src)", "n AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM verts)", "r0 AS MATERIALIZED (SELECT v, 1 / n AS pr FROM verts, n)"]
    for i in range(1, steps + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT verts.v, ({jump} + {1 - jump} * (SELECT coalesce(sum(pr), 0) FROM r{i - 1} WHERE v NOT IN (SELECT src FROM deg))) / n + {1 - jump} * coalesce(f, 0) AS pr FROM verts CROSS JOIN n LEFT JOIN (SELECT c.dst AS v, sum(r.pr / d.k) AS f FROM cites c JOIN deg d ON c.src = d.src JOIN r{i - 1} r ON r.v = c.src GROUP BY c.dst) f ON f.v = verts.v)")
    return f"WITH {', '.join(parts)} SELECT v, round(pr * 1e6, 4) AS pr FROM r{steps}"


@query(_jump_sql(6))
def pagerank_by_jump(spark, d):
    ranks = graph.pagerank_by_jump(graph.citation_edges(table(spark, d, "citations")), tolerance=0, max_iter=6)
    return ranks.select("v", F.round(F.col("pr") * 1e6, 4).alias("pr"))


_AUTHOR_EDGES = f"WITH {CITES}, {LINKS}, e AS (SELECT a.aut_id AS src, b.aut_id AS dst, count(*) AS weight FROM cites c JOIN links a ON a.doc_id = c.src JOIN links b ON b.doc_id = c.dst GROUP BY ALL)"


@query(f"{_AUTHOR_EDGES} SELECT src, dst, weight FROM e")
def author_edges(spark, d):
    return graph.author_edges(table(spark, d, "citations"), table(spark, d, "document_authors"))


@query(f"{_AUTHOR_EDGES} SELECT src, dst, weight, a.aut_name AS src_name, b.aut_name AS dst_name FROM e JOIN authors a ON a.aut_id = src JOIN authors b ON b.aut_id = dst")
def author_graph(spark, d):
    return graph.author_graph(table(spark, d, "citations"), table(spark, d, "document_authors"), table(spark, d, "authors")).select("src", "dst", "weight", "src_name", "dst_name")


@query(f"WITH {CITES}, one AS (SELECT doc_id, any_value(rank) AS rank FROM documents_data GROUP BY doc_id) SELECT src, dst, a.title AS src_title, b.title AS dst_title FROM cites JOIN documents a ON a.doc_id = src JOIN documents b ON b.doc_id = dst JOIN one x ON x.doc_id = src JOIN one y ON y.doc_id = dst")
def document_graph(spark, d):
    t = tables_of(spark, d)
    return graph.document_graph(t["citations"], t["documents"], t["documents_data"]).select("src", "dst", "src_title", "dst_title")


@query(f"WITH {LINKS}, one AS (SELECT doc_id, any_value(CASE WHEN isnan(relevance_doc) THEN 0 ELSE coalesce(relevance_doc, 0) END) AS r FROM documents_data GROUP BY doc_id), s AS (SELECT doc_id, sum(coalesce(relevance, 0)) AS a FROM links JOIN authors USING (aut_id) GROUP BY doc_id) SELECT doc_id, round(a, 6) AS relevance_aut, round(0.7 * r + 0.3 * a, 6) AS rank FROM s JOIN one USING (doc_id)")
def combined_rank(spark, d):
    t = tables_of(spark, d)
    got = graph.combined_rank(t["documents_data"].dropDuplicates(["doc_id"]), t["authors"], t["document_authors"], 0.7, 0.3)
    return got.select("doc_id", F.round("relevance_aut", 6).alias("relevance_aut"), F.round("rank", 6).alias("rank"))


@query(f"WITH {CITES}, {DATA}, s AS (SELECT doc_id FROM documents JOIN dat USING (doc_id) WHERE enabled ORDER BY dat.rank DESC, doc_id LIMIT 500) SELECT src AS doc_id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS refs FROM cites WHERE src IN (SELECT doc_id FROM s) AND dst IN (SELECT doc_id FROM s) GROUP BY src")
def references_within_set(spark, d):
    shown = service.search(tables_of(spark, d), max_docs=500).documents
    return graph.references_within(table(spark, d, "citations"), shown).select("doc_id", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"))


@query(f"WITH {CITES} SELECT src AS v FROM cites UNION SELECT dst FROM cites")
def citation_vertices(spark, d):
    return graph.vertices(graph.citation_edges(table(spark, d, "citations")))


# Ingest ------------------------------------------------------------------------------------------

_UPSERT_FIELDS = ("title", "keywords", "abstract", "authors")


@query("WITH r AS (SELECT doc_id, lower(replace(doi, ' ', '')) AS doi, title, keywords, abstract, authors, added_at FROM documents) SELECT min_by(doc_id, (added_at, doc_id)) AS doc_id, doi, " + ", ".join(f"arg_min({c}, CASE WHEN {c} IS NOT NULL THEN (added_at, doc_id) END) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _UPSERT_FIELDS) + " FROM r WHERE doi IS NOT NULL GROUP BY doi UNION ALL SELECT doc_id, doi, title, keywords, abstract, authors FROM r WHERE doi IS NULL")
def upsert_documents(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.replace(F.lower("doi"), F.lit(" "), F.lit("")).alias("doi"), *_UPSERT_FIELDS, "added_at")
    return ingest.upsert_documents(rows, "added_at")


@query("WITH new AS (SELECT DISTINCT 'University ' || aut_name AS aut_name FROM authors WHERE aut_name IS NOT NULL AND 'University ' || aut_name NOT IN (SELECT aut_name FROM authors WHERE aut_name IS NOT NULL)) SELECT aut_id, aut_name FROM authors UNION ALL SELECT (SELECT max(aut_id) FROM authors) + row_number() OVER (ORDER BY aut_name), aut_name FROM new")
def upsert_authors(spark, d):
    a = table(spark, d, "authors")
    return ingest.upsert_authors(a, a.select(F.concat(F.lit("University "), "aut_name").alias("aut_name")))


@query("SELECT min(id) AS id, doc_id, aut_id FROM document_authors WHERE doc_id IS NOT NULL AND aut_id IS NOT NULL GROUP BY doc_id, aut_id")
def link_authors(spark, d):
    return ingest.link_authors(table(spark, d, "document_authors"))


@query("SELECT min(id) AS id, doc_id, ref_id FROM citations WHERE doc_id IS NOT NULL AND ref_id IS NOT NULL AND doc_id <> ref_id GROUP BY doc_id, ref_id")
def link_citations(spark, d):
    return ingest.link_citations(table(spark, d, "citations"))


_GONE = "(SELECT doc_id FROM documents WHERE NOT enabled)"


@query(f"SELECT 'citations' AS tab, id FROM citations WHERE (doc_id IS NULL OR doc_id NOT IN {_GONE}) AND (ref_id IS NULL OR ref_id NOT IN {_GONE}) UNION ALL SELECT 'document_authors', id FROM document_authors WHERE doc_id IS NULL OR doc_id NOT IN {_GONE} UNION ALL SELECT 'documents_data', doc_id FROM documents_data WHERE doc_id NOT IN {_GONE} UNION ALL SELECT 'documents', doc_id FROM documents WHERE doc_id NOT IN {_GONE}")
def delete_documents(spark, d):
    """What is left in the four tables."""
    names = ("citations", "document_authors", "documents_data", "documents")
    left = ingest.delete_documents({n: table(spark, d, n) for n in names}, table(spark, d, "documents").where("NOT enabled"))
    parts = [left[n].select(F.lit(n).alias("tab"), F.col("id" if "id" in left[n].columns else "doc_id").alias("id")) for n in names]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT ref_id FROM citations WHERE ref_id IS NOT NULL) THEN FALSE ELSE enabled END AS enabled FROM documents")
def disable_documents(spark, d):
    ids = table(spark, d, "citations").where("ref_id IS NOT NULL").select(F.col("ref_id").alias("doc_id"))
    return ingest.disable_documents(table(spark, d, "documents"), ids).select("doc_id", "enabled")


@query(f"WITH {LINKS}, n AS (SELECT doc_id, CAST(count(*) AS DOUBLE) AS rank FROM links GROUP BY doc_id), one AS (SELECT DISTINCT doc_id FROM documents_data) SELECT doc_id, n.rank AS rank FROM one JOIN n USING (doc_id)")
def update_columns(spark, d):
    t = tables_of(spark, d)
    new = ingest.link_authors(t["document_authors"]).groupBy("doc_id").agg(F.count(F.lit(1)).cast("double").alias("rank"))
    old = t["documents_data"].select("doc_id").distinct().withColumn("rank", F.lit(None).cast("double"))
    return ingest.update_columns(old, new, "doc_id", ["rank"]).where("rank IS NOT NULL")


@query("WITH a AS (SELECT doc_id, title, abstract FROM documents), s AS (SELECT doc_id, container AS title, keywords AS abstract FROM documents) SELECT doc_id, coalesce(a.title, s.title) AS title, coalesce(a.abstract, s.abstract) AS abstract FROM a LEFT JOIN s USING (doc_id)")
def fill_missing(spark, d):
    docs = table(spark, d, "documents")
    other = docs.select("doc_id", F.col("container").alias("title"), F.col("keywords").alias("abstract"))
    return ingest.fill_missing(docs.select("doc_id", "title", "abstract"), other, "doc_id", ["title", "abstract"])


@query("WITH one AS (SELECT doc_id, any_value(x) AS x, any_value(y) AS y FROM documents_data GROUP BY doc_id) SELECT doc_id, round(coalesce(x, 0), 6) AS x, round(coalesce(y, 0), 6) AS y FROM documents LEFT JOIN one USING (doc_id)")
def data_rows(spark, d):
    got = ingest.with_data_rows(table(spark, d, "documents"), table(spark, d, "documents_data"))
    return got.select("doc_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT doc_id, coalesce(trim(title) <> '', FALSE) OR coalesce(trim(keywords) <> '', FALSE) OR coalesce(trim(abstract) <> '', FALSE) AS complete FROM documents")
def complete_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", ingest.is_complete().alias("complete"))


@query("WITH e AS (SELECT doc_id, string_split(regexp_replace(authors, ';+$', ''), ';') AS l FROM documents WHERE authors IS NOT NULL), u AS (SELECT doc_id, unnest(l) AS a, generate_subscripts(l, 1) AS place FROM e) SELECT doc_id, CAST(place AS INT) AS place, lower(trim(regexp_replace(regexp_replace(a, '[,;.\\-\\[\\]]', ' ', 'g'), '\\s\\s', ' ', 'g'))) AS name FROM u")
def author_names(spark, d):
    rows = table(spark, d, "documents").where("authors IS NOT NULL").select("doc_id", F.posexplode(strings.author_names(F.col("authors"))).alias("place", "name"))
    return rows.select("doc_id", (F.col("place") + 1).alias("place"), F.lower("name").alias("name"))


@query("SELECT doc_id, CASE WHEN regexp_full_match(pages, '\\w*\\d{4}\\w*') THEN CAST(regexp_extract(pages, '^\\w*(\\d{4})\\w*$', 1) AS INT) ELSE coalesce(TRY_CAST(pages AS INT), 0) END AS year FROM documents")
def year_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", strings.extract_year(F.col("pages")).alias("year"))


@query("SELECT doc_id, regexp_replace(regexp_replace(doi, '^\\s*(?i:doi):', ''), ' ', '', 'g') AS doi FROM documents")
def clean_dois(spark, d):
    return table(spark, d, "documents").select("doc_id", strings.clean_doi(F.col("doi")).alias("doi"))


@query("SELECT doc_id, TRY_CAST(nullif(regexp_extract(string_split(pages, '-')[1], '^\\s*([+-]?\\d+)\\s*$', 1), '') AS INT) AS first, TRY_CAST(nullif(regexp_extract(string_split(pages, '-')[2], '^\\s*([+-]?\\d+)\\s*$', 1), '') AS INT) AS last FROM documents")
def page_ranges(spark, d):
    return table(spark, d, "documents").select("doc_id", strings.page_bounds(F.col("pages")).alias("p")).select("doc_id", "p.first", "p.last")


@query("SELECT doc_id, nullif(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '') AS title, nullif(array_to_string(list_filter(list_transform(string_split(authors, ';'), lambda a: regexp_replace(a, '^\\s+|\\s+$', '', 'g')), lambda a: a <> ''), ';'), '') AS authors, nullif(regexp_replace(regexp_replace(abstract, '\\s+', ' ', 'g'), '^ | $', '', 'g'), '') AS abstract FROM documents")
def html_fields(spark, d):
    """Pages made from the records, read back by their meta elements."""
    e = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit("&quot;"))
    page = F.concat(F.lit('<html><head><meta name="citation_title" content="'), e("title"), F.lit('"><meta name="DC.creator" content="'), e("authors"), F.lit('"></head><body><p class="abstract">'), F.coalesce("abstract", F.lit("")), F.lit("</p></body></html>"))
    return table(spark, d, "documents").select("doc_id", documents_in.html_fields(page).alias("f")).select("doc_id", "f.title", "f.authors", "f.abstract")


@query("SELECT title, doi, coalesce(publication_date, 0) AS publication_date FROM documents")
def catalogue_records(spark, d):
    """Records written as catalogue JSON and read back."""
    item = F.struct("title", F.lit("journal-article").alias("type"), F.col("publication_date").alias("year"), F.struct("doi").alias("identifiers"))
    lines = table(spark, d, "documents").select(F.to_json(F.array(item)).alias("json"))
    return documents_in.catalogue_records(lines).select("title", "doi", "publication_date")


# Vectors -----------------------------------------------------------------------------------------


def _vector_pairs(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    some = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("u"))
    return against_all(some, rows).where("a <> b")


def _distances(spark, d, kind):
    f = vectors.dissimilarity(kind)
    return _vector_pairs(spark, d).select("a", "b", F.round(f(F.col("u"), F.col("v")), 5).alias("distance"))


_PAIRS = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(a.embedding AS DOUBLE[]) AS u, CAST(b.embedding AS DOUBLE[]) AS v FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), q AS (SELECT *, list_dot_product(u, v) AS d, list_dot_product(u, u) AS n, list_dot_product(v, v) AS m FROM p)"
_DISTANCE_SQL = {
    "EUCLIDEAN": "sqrt(abs(n + m - 2 * d))", "COSINE_BASED": "1 - greatest(least(d / sqrt(n) / sqrt(m), 1), -1)", "EXTENDED_JACCARD": "1 / (1 + d / (n + m - d))",
    "CITY_BLOCK": "list_sum(list_transform(list_zip(u, v), lambda x: abs(x[1] - x[2])))", "INFINITY_NORM": "list_max(list_transform(list_zip(u, v), lambda x: abs(x[1] - x[2])))",
}
for _k, _e in _DISTANCE_SQL.items():
    query(f"WITH {_PAIRS} SELECT a, b, round({_e}, 5) AS distance FROM q", f"dist_{_k.lower()}")(lambda spark, d, k=_k: _distances(spark, d, k))


@query()
def dist_dynamic_time_warping(spark, d):
    return _distances(spark, d, "DYNAMIC_TIME_WARPING")


@query(f"WITH {_PAIRS} SELECT a, b, CAST(k AS INT) AS place FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(sqrt(abs(n + m - 2 * d)), 8), b) AS k FROM q) WHERE k <= 5")
def nearest_vectors(spark, d):
    got = nearest(_vector_pairs(spark, d), "a", "b", F.round(vectors.euclidean(F.col("u"), F.col("v")), 8), 5)
    return got.select("a", "b", "place")


@query("WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) SELECT label, CAST(i - 1 AS INT) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM e GROUP BY ALL")
def vector_mean(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return rows.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings")
def vector_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"))


def _features(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


@query()
def bkmeans(spark, d):
    rows, _ = cluster.bisecting_kmeans(_features(spark, d), 8)
    return rows.select("id", "cluster")


@query()
def kmeans_medoids(spark, d):
    rows, centroids = cluster.bisecting_kmeans(_features(spark, d), 8)
    return cluster.medoids(rows, centroids)


@query()
def lamp(spark, d):
    return projection.lamp(_features(spark, d))


@query()
def representative_points(spark, d):
    return projection.control_points(_features(spark, d), 40, "REPRESENTATIVE").select("id")


# The plane ---------------------------------------------------------------------------------------

def _quartile_sql(column: str, p: int) -> str:
    pos = f"least(greatest({p} * (n + 1) / 100, 1), n)"
    return f"(SELECT l[CAST(floor({pos}) AS INT)] + ({pos} - floor({pos})) * (l[CAST(ceil({pos}) AS INT)] - l[CAST(floor({pos}) AS INT)]) FROM (SELECT list_sort(list({column})) AS l, count(*) AS n FROM pts))"


_FENCES = f"q AS (SELECT {_quartile_sql('x', 25)} AS x1, {_quartile_sql('x', 75)} AS x3, {_quartile_sql('y', 25)} AS y1, {_quartile_sql('y', 75)} AS y3), m AS (SELECT pts.*, x < x1 - 1.5 * (x3 - x1) OR x > x3 + 1.5 * (x3 - x1) OR y < y1 - 1.5 * (y3 - y1) OR y > y3 + 1.5 * (y3 - y1) AS outlier FROM pts, q)"


@query(f"WITH {PTS}, {_FENCES} SELECT round(x1, 6) AS x1, round(x3, 6) AS x3, round(y1, 6) AS y1, round(y3, 6) AS y3 FROM q")
def quartiles_legacy(spark, d):
    p = points_of(spark, d)
    (x1, x3), (y1, y3) = legacy_percentiles(p, "x", [25, 75]), legacy_percentiles(p, "y", [25, 75])
    return spark.createDataFrame([(round(x1, 6), round(x3, 6), round(y1, 6), round(y3, 6))], "x1 double, x3 double, y1 double, y3 double")


@query(f"WITH {PTS}, {_FENCES} SELECT doc_id FROM m WHERE outlier")
def outliers_iqr(spark, d):
    return spatial.mark_outliers(points_of(spark, d)).where("outlier").select("doc_id")


@query(f"WITH {PTS}, {_FENCES}, k AS (SELECT * FROM m WHERE NOT outlier), b AS (SELECT min(x) AS a, max(x) AS c, min(y) AS e, max(y) AS f FROM k) SELECT doc_id, round(2 * (x - a) / (c - a) - 1, 6) AS x, round(2 * (y - e) / (f - e) - 1, 6) AS y FROM k, b")
def normalize_xy(spark, d):
    got = spatial.normalise(spatial.mark_outliers(points_of(spark, d)))
    return got.select("doc_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {PTS} SELECT doc_id, round(x, 6) AS x, round(y, 6) AS y FROM pts WHERE x >= -0.4 AND x <= 0.3 AND y >= -0.2 AND y <= 0.6")
def rect_search(spark, d):
    return spatial.in_rectangle(points_of(spark, d, (-0.4, -0.2, 0.3, 0.6)), (0.3, -0.2), (-0.4, 0.6)).select("doc_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {PTS} SELECT doc_id FROM pts WHERE x > -0.4 AND x <= 0.3 AND y > -0.2 AND y <= 0.6 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE NOT enabled)")
def rect_search_halfopen(spark, d):
    gone = table(spark, d, "documents").where("NOT enabled").select("doc_id")
    return spatial.in_rectangle(points_of(spark, d, (-0.4, -0.2, 0.3, 0.6)), (-0.4, -0.2), (0.3, 0.6), half_open=True, without=gone).select("doc_id")


@query(f"WITH {PTS} SELECT doc_id, round((x - 0.1) * (x - 0.1) + (y + 0.2) * (y + 0.2), 6) AS d2 FROM pts WHERE rank >= 0.1 AND (x - 0.1) * (x - 0.1) + (y + 0.2) * (y + 0.2) <= 0.3 * 0.3")
def radius_search(spark, d):
    return spatial.in_radius(points_of(spark, d, (-0.2, -0.5, 0.4, 0.1)), 0.1, -0.2, 0.3, 0.1).select("doc_id", F.round("d2", 6).alias("d2"))


@query(f"WITH {PTS}, r AS (SELECT doc_id, coalesce(sum(rank) OVER (ORDER BY rank DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pts WHERE rank IS NOT NULL) SELECT doc_id FROM r WHERE before < 20.0")
def rank_budget(spark, d):
    return spatial.rank_budget(points_of(spark, d), 20.0).select("doc_id")


_DEPTH, _CAP = 10, 28
_KEYED = f"k AS (SELECT doc_id, rank, greatest(least(CAST(floor((x + 1) * {1 << _DEPTH} / 2) AS BIGINT), {(1 << _DEPTH) - 1}), 0) AS kx, greatest(least(CAST(floor((y + 1) * {1 << _DEPTH} / 2) AS BIGINT), {(1 << _DEPTH) - 1}), 0) AS ky FROM pts)"
_ID = "(CAST((pow(4, d) - 1) / 3 AS BIGINT) + " + " + ".join(f"((((cx >> {b}) & 1) * 2 + ((cy >> {b}) & 1)) * {4**b})" for b in range(_DEPTH)) + ")"
_LEVEL = f"lv AS (SELECT doc_id, rank, d, kx >> ({_DEPTH} - d) AS cx, ky >> ({_DEPTH} - d) AS cy FROM k, (SELECT CAST(unnest(range(1, {_DEPTH + 1})) AS INT) AS d)), cell AS (SELECT d, cx, cy, count(*) AS n, min(rank) AS lo, max(rank) AS hi FROM lv GROUP BY ALL)"


@query(f"WITH {PTS}, {_KEYED}, {_LEVEL}, leaf AS (SELECT lv.doc_id, min(lv.d) AS d FROM lv JOIN cell USING (d, cx, cy) WHERE n <= {_CAP} OR lv.d = {_DEPTH} GROUP BY 1) SELECT doc_id, {_ID} AS leaf_id, d AS leaf_depth FROM leaf JOIN lv USING (doc_id, d)")
def quadtree_leaves(spark, d):
    return spatial.assign_leaves(points_of(spark, d), _DEPTH, _CAP).select("doc_id", "leaf_id", "leaf_depth")


@query(f"WITH {PTS}, {_KEYED}, {_LEVEL}, par AS (SELECT 0 AS d, 0 AS cx, 0 AS cy UNION ALL SELECT d, cx, cy FROM cell WHERE n > {_CAP} AND d < {_DEPTH}), ch AS (SELECT CAST(d + 1 AS INT) AS d, cx * 2 + i // 2 AS cx, cy * 2 + i % 2 AS cy, CAST(i AS INT) AS index FROM par, (SELECT unnest(range(4)) AS i)), nd AS (SELECT ch.d, ch.cx, ch.cy, index, coalesce(n, 0) AS n, lo, hi FROM ch LEFT JOIN cell USING (d, cx, cy)) SELECT {_ID} AS node_id, n <= {_CAP} OR d = {_DEPTH} AS isleaf, round(lo, 6) AS rankmin, round(hi, 6) AS rankmax, ({_ID} - 1) // 4 AS parent_id, d AS depth, index, n FROM nd UNION ALL SELECT 0, FALSE, round(min(rank), 6), round(max(rank), 6), NULL, 0, NULL, count(*) FROM pts")
def quadtree_nodes(spark, d):
    got = spatial.quadtree_nodes(points_of(spark, d), _DEPTH, _CAP)
    return got.withColumns({"rankmin": F.round("rankmin", 6), "rankmax": F.round("rankmax", 6)})


@query("SELECT node_id, coalesce(n, 0) AS n FROM nodes LEFT JOIN (SELECT node_id, count(DISTINCT doc_id) AS n FROM documents_data GROUP BY 1) USING (node_id)")
def node_counts(spark, d):
    counts = table(spark, d, "documents_data").dropDuplicates(["doc_id"]).where("node_id IS NOT NULL").groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "nodes").select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH one AS (SELECT DISTINCT doc_id, node_id, rank FROM documents_data WHERE node_id IS NOT NULL AND rank IS NOT NULL AND NOT isnan(rank)), r AS (SELECT doc_id, node_id, rank() OVER (PARTITION BY node_id ORDER BY rank DESC) AS place FROM one) SELECT doc_id, node_id, CAST(place AS INT) AS place FROM r WHERE place <= 28")
def node_top_documents(spark, d):
    rows = table(spark, d, "documents_data").where("node_id IS NOT NULL AND rank IS NOT NULL AND NOT isnan(rank)").dropDuplicates(["doc_id"])
    return rows.withColumn("place", F.rank().over(W.partitionBy("node_id").orderBy(F.desc("rank")))).where("place <= 28").select("doc_id", "node_id", "place")


_BW = "c AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n FROM pts), a AS (SELECT sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS d FROM pts, c), bw AS (SELECT 0.9 * least(sqrt(avg(d * d)), sqrt(1 / ln(2)) * median(d)) * pow(count(*), -0.2) AS bw FROM a)"


@query(f"WITH {PTS}, {_BW} SELECT round(bw, 6) AS bw FROM bw")
def kde_bandwidth(spark, d):
    return spark.createDataFrame([(round(density.bandwidth(points_of(spark, d)), 6),)], "bw double")


@query(f"WITH {PTS}, {_BW}, g AS (SELECT bw, CAST(ceil(2 / bw) AS INT) + 1 AS w FROM bw), s AS (SELECT bw, w, (w * 6) // 16 AS h, 2.0 / greatest(1, (w * 6) // 16 - 1) AS sx FROM g), v AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, -1 + sx / 2 + i * sx AS px, -1 + bw / 2 + j * bw AS py, bw FROM s, (SELECT unnest(range(500)) AS i), (SELECT unnest(range(500)) AS j) WHERE i < h AND j < w), t AS (SELECT i, j, px, py, bw, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d FROM v, pts WHERE abs(x - px) <= bw AND abs(y - py) <= bw) SELECT i, j, round(any_value(px), 6) AS px, round(any_value(py), 6) AS py, round(sum(0.75 * (1 - (d / bw) * (d / bw))), 4) AS density FROM t WHERE d < bw GROUP BY i, j")
def kde_grid(spark, d):
    p = points_of(spark, d)
    grid = density.density_grid(p, (-1.0, -1.0, 1.0, 1.0), density.bandwidth(p))
    return grid.select("i", "j", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), F.round("density", 4).alias("density"))


@query(f"WITH {PTS}, b AS (SELECT min(rank) AS lo, max(rank) AS hi FROM pts) SELECT doc_id, round((rank - lo) / (hi - lo) * (30 - 4) + 4) AS radius FROM pts, b WHERE rank IS NOT NULL")
def radius_scale(spark, d):
    p = points_of(spark, d).where("rank IS NOT NULL")
    lo, hi = p.agg(F.min("rank"), F.max("rank")).first()
    return p.select("doc_id", mathx.radius_scale(F.col("rank"), F.lit(lo), F.lit(hi), 4.0, 30.0).alias("radius"))


# Further reports ---------------------------------------------------------------------------------


@query(f"WITH {DATA}, s AS (SELECT doc_id, row_number() OVER (ORDER BY dat.rank DESC, doc_id) - 1 AS i FROM documents JOIN dat USING (doc_id) WHERE enabled) SELECT doc_id FROM s WHERE i >= 10 AND i <= 30")
def rank_slider(spark, d):
    """The shown documents from place lo - 1 to hi (from 0), as the slider cuts them."""
    t = tables_of(spark, d)
    shown = service.simple_documents(t["documents"], t["documents_data"])
    return service.page_of(shown, 31).orderBy("rank", F.desc("doc_id")).limit(21).select("doc_id")


@query(f"WITH {DATA}, c AS (SELECT count(*) AS n FROM documents JOIN dat USING (doc_id) WHERE enabled AND {_has('depth')}) SELECT CAST(n // 100 AS BIGINT) AS pages, CAST(101 AS BIGINT) AS first, CAST(least(200, n) AS BIGINT) AS last FROM c")
def pagination(spark, d):
    answer = service.search(tables_of(spark, d), terms="depth", page=1)
    p = service.pages(answer.ndocs, 100, 1)
    return spark.createDataFrame([(p["pages"], p["first"], p["last"])], "pages long, first long, last long")


@query(f"WITH {DATA} SELECT doc_id, CAST(doc_id AS VARCHAR) AS json_id, doi, title, authors, keywords, CAST(publication_date AS VARCHAR) AS publication_date, round(dat.rank, 6) AS rank, list_sort(list_transform(words[1:10], lambda e: e.word || ':' || e.nentry)) AS words FROM documents JOIN dat USING (doc_id) WHERE enabled AND {_has('depth')} ORDER BY dat.rank DESC, doc_id LIMIT 100")
def search_json(spark, d):
    """The shown documents as JSON, read back field by field."""
    rows = service.answer_json(service.search(tables_of(spark, d), terms="depth"), 100)
    f = lambda c: F.get_json_object("json", f"$.{c}")
    words = F.array_sort(F.transform(text.stored_counts(f("words")), lambda e: F.concat_ws(":", e["word"], e["nentry"].cast("string"))))
    return rows.select("doc_id", f("doc_id").alias("json_id"), *[f(c).alias(c) for c in ("doi", "title", "authors", "keywords", "publication_date")], F.round(f("rank").cast("double"), 6).alias("rank"), words.alias("words"))


@query(f"WITH {CITES}, {DATA}, s AS (SELECT doc_id FROM documents JOIN dat USING (doc_id) WHERE enabled ORDER BY dat.rank DESC, doc_id LIMIT 100) SELECT src AS doc_id, '[' || string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) || ']' AS json FROM cites WHERE src IN (SELECT doc_id FROM s) AND dst IN (SELECT doc_id FROM s) GROUP BY src")
def references_json(spark, d):
    return service.references(table(spark, d, "citations"), service.search(tables_of(spark, d)).documents)


@query(f"WITH {CITES}, one AS (SELECT doc_id, any_value(rank) AS rank FROM documents_data GROUP BY doc_id) SELECT src, dst, a.title AS src_title, b.title AS dst_title, round(x.rank, 6) AS src_rank FROM cites JOIN documents a ON a.doc_id = src JOIN documents b ON b.doc_id = dst JOIN one x ON x.doc_id = src JOIN one y ON y.doc_id = dst")
def graph_json(spark, d):
    """The citation graph as JSON, one text an edge, read back field by field."""
    edges = graph.document_graph(table(spark, d, "citations"), table(spark, d, "documents"), table(spark, d, "documents_data"))
    lines = edges.select("src", "dst", F.to_json(F.struct("src", "src_title", "src_rank", "dst", "dst_title", "dst_rank")).alias("json"))
    f = lambda c: F.get_json_object("json", f"$.{c}")
    return lines.select("src", "dst", f("src_title").alias("src_title"), f("dst_title").alias("dst_title"), F.round(f("src_rank").cast("double"), 6).alias("src_rank"))


@query(f"WITH {PTS} SELECT doc_id, CAST(least(greatest(floor(rank / 7.0 * 7) + 1, 0), 8) AS BIGINT) AS bucket FROM pts WHERE rank IS NOT NULL")
def colour_bucket(spark, d):
    return points_of(spark, d).where("rank IS NOT NULL").select("doc_id", mathx.colour_bucket(F.col("rank"), 0.0, 7.0).alias("bucket"))


@query("WITH t AS (SELECT doc_id, unnest(freqs) AS e FROM documents), w AS (SELECT doc_id, e.word AS word, 1 + 2 * ln(e.nentry) AS weight FROM t WHERE e.nentry > 0) SELECT word, round(sum(weight) / (SELECT count(*) FROM documents), 6) AS weight FROM w GROUP BY word")
def matrix_mean(spark, d):
    docs = table(spark, d, "documents")
    words = docs.select(F.explode("freqs").alias("e")).select(F.col("e.word").alias("word")).distinct().withColumn("ndoc", F.lit(1))
    return termmatrix.mean_vector(termmatrix.frequency_matrix(docs, words, 1, 3), docs.count()).select("word", F.round("weight", 6).alias("weight"))


@query("WITH t AS (SELECT doc_id, unnest(freqs) AS e FROM documents), w AS (SELECT doc_id, e.word AS word, 1 + 2 * ln(e.nentry) AS weight FROM t WHERE e.nentry > 0), n AS (SELECT doc_id, sqrt(sum(weight * weight)) AS n FROM w GROUP BY doc_id) SELECT word AS doc_id, count(*) AS n, round(sum(weight / n.n), 5) AS weight FROM w JOIN n USING (doc_id) GROUP BY word")
def matrix_transposed(spark, d):
    """Unit rows, turned: what each word has over all documents."""
    docs = table(spark, d, "documents")
    words = docs.select(F.explode("freqs").alias("e")).select(F.col("e.word").alias("word")).distinct().withColumn("ndoc", F.lit(1))
    turned = termmatrix.transpose(termmatrix.normalise_rows(termmatrix.frequency_matrix(docs, words, 1, 3)))
    return turned.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 5).alias("weight"))


@query("SELECT doc_id, CASE WHEN len(words) >= 3 THEN array_to_string(list_transform(words[3:4], lambda e: e.word), ' ') END AS part FROM documents WHERE words IS NOT NULL")
def word_sublist(spark, d):
    """The words of a list from place 2 up to 4 (from 0); none left gives null."""
    part = F.slice("words", 3, 2)
    return table(spark, d, "documents").where("words IS NOT NULL").select("doc_id", F.when(F.size(part) > 0, F.array_join(F.transform(part, lambda e: e["word"]), " ")).alias("part"))


# The root of the rows is placed by the projection, all rows by an affine map from it.


@query()
def fastmap(spark, d):
    return projection.lamp(_features(spark, d), place=lambda x: projection.fastmap(projection.pairwise(x)))


@query()
def idmap(spark, d):
    return projection.lamp(_features(spark, d), place=projection.idmap)


@query()
def nearest_neighbour_projection(spark, d):
    return projection.lamp(_features(spark, d), place=lambda x: projection.normalise_keeping_aspect(projection.nearest_neighbour_projection(projection.pairwise(x))))


@query(f"WITH {CITES}, r AS (SELECT src, dst, a.doi AS own, b.doi AS other FROM cites JOIN documents a ON a.doc_id = src JOIN documents b ON b.doc_id = dst) SELECT src AS doc_id, other AS doi FROM r WHERE coalesce(own <> other, TRUE)")
def parsed_references(spark, d):
    """References gathered per document and taken apart again, without a document's own DOI."""
    docs = table(spark, d, "documents").select("doc_id", "doi")
    cited = graph.citation_edges(table(spark, d, "citations")).join(docs.select(F.col("doc_id").alias("dst"), F.col("doi").alias("ref_doi")), "dst")
    lists = cited.groupBy("src").agg(F.collect_list(F.struct(F.col("ref_doi").alias("doi"))).alias("references")).withColumnRenamed("src", "doc_id")
    return ingest.references_of(docs.join(lists, "doc_id"))


@query("SELECT min(aut_id) AS aut_id, lower(aut_name) AS aut_name FROM authors WHERE list_contains(regexp_extract_all(lower(aut_name), '[\\p{L}\\p{N}]+'), 'university') GROUP BY 2")
def author_search(spark, d):
    hit = text.matches(text.build_query("university", "and"), text.vector_map(text.to_vector(F.col("aut_name"))))
    return table(spark, d, "authors").where(hit).groupBy(F.lower("aut_name").alias("aut_name")).agg(F.min("aut_id").alias("aut_id"))


@query("SELECT a.node_id, a.depth, count(b.node_id) AS children, round(min(b.rankmin), 6) AS lowest FROM nodes a LEFT JOIN nodes b ON b.parent_id = a.node_id GROUP BY ALL")
def node_children(spark, d):
    nodes = table(spark, d, "nodes")
    below = nodes.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"), F.round(F.min("rankmin"), 6).alias("lowest"))
    return nodes.select("node_id", "depth").join(below, "node_id", "left").select("node_id", "depth", F.coalesce("children", F.lit(0)).alias("children"), "lowest")


_FORM = "nullif(regexp_replace(replace(lower({c}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"


@query(f"WITH c AS (SELECT {_FORM.format(c='title')} AS t, {_FORM.format(c='authors')} AS a, min(doi) AS got FROM documents WHERE doi IS NOT NULL GROUP BY 1, 2) SELECT doc_id, coalesce(doi, got) AS doi FROM documents LEFT JOIN c ON c.t = {_FORM.format(c='title')} AND c.a = {_FORM.format(c='authors')}")
def lookup_by_title_author(spark, d):
    """Missing DOIs from a catalogue by title and authors; the records with a DOI serve as the catalogue."""
    docs = table(spark, d, "documents").select("doc_id", "doi", "title", "authors")
    return ingest.lookup(docs, docs.where("doi IS NOT NULL"), ["title", "authors"], ["doi"]).select("doc_id", "doi")


@query()
def point_clusters(spark, d):
    """The places of the documents in four clusters."""
    rows = points_of(spark, d).select(F.col("doc_id").alias("id"), F.array("x", "y").alias("features"))
    return cluster.bisecting_kmeans(rows, 4)[0].select("id", "cluster")


@query(f"WITH {PTS} SELECT CAST(floor((x + 1) * 2) AS BIGINT) AS cx, count(*) AS n, round(sum((x - 0.5) * (x - 0.5) + y * y), 4) AS d2 FROM pts WHERE (x - 0.5) * (x - 0.5) + y * y <= 0.16 GROUP BY 1")
def neighbour_sums(spark, d):
    """Neighbours within a radius of a place and the sum of their squared distances, by column of the plane."""
    near = spatial.in_radius(points_of(spark, d).withColumn("rank", F.coalesce("rank", F.lit(0.0))), 0.5, 0.0, 0.4)
    return near.groupBy(F.floor((F.col("x") + 1) * 2).alias("cx")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d2"), 4).alias("d2"))


# Zoom and density ---------------------------------------------------------------------------------


def _grid_sql(points: str, x1: float, y1: float, x2: float, y2: float) -> str:
    """Kernel density of the points of a query (x, y) in a box."""
    return (
        f"WITH {DATA}, pts AS ({points}), {_BW}, g AS (SELECT bw, CAST(ceil(({y2} - {y1}) / bw) AS INT) + 1 AS w FROM bw), s AS (SELECT bw, w, (w * 6) // 16 AS h, ({x2} - {x1}) / greatest(1, (w * 6) // 16 - 1) AS sx FROM g), "
        f"v AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, {x1} + sx / 2 + i * sx AS px, {y1} + bw / 2 + j * bw AS py, bw FROM s, (SELECT unnest(range(500)) AS i), (SELECT unnest(range(500)) AS j) WHERE i < h AND j < w), "
        "t AS (SELECT i, j, bw, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d FROM v, pts WHERE abs(x - px) <= bw AND abs(y - py) <= bw) "
        "SELECT i, j, round(sum(0.75 * (1 - (d / bw) * (d / bw))), 4) AS density FROM t WHERE d < bw GROUP BY i, j"
    )


def _grid(answer: service.Answer) -> DataFrame:
    return answer.grid.select("i", "j", F.round("density", 4).alias("density"))


@query(_grid_sql(f"SELECT x, y FROM (SELECT x, y, row_number() OVER (ORDER BY rank DESC, doc_id) AS k FROM documents JOIN dat USING (doc_id) WHERE enabled AND {_has('depth')}) WHERE k > 100", -1, -1, 1, 1))
def search_density(spark, d):
    """The density of the documents behind the first page."""
    return _grid(service.search(tables_of(spark, d), terms="depth"))


@query(_grid_sql(f"SELECT x, y FROM (SELECT x, y, row_number() OVER (ORDER BY rank DESC, doc_id) AS k FROM documents JOIN dat USING (doc_id) WHERE enabled AND {_has('depth')} AND x BETWEEN -0.5 AND 0.5 AND y BETWEEN -0.25 AND 0.75) WHERE k > 20", -0.5, -0.25, 0.5, 0.75))
def zoom_density(spark, d):
    """The density of the documents in a zoomed box behind its first page."""
    return _grid(service.search(tables_of(spark, d), terms="depth", start=(0.5, 0.75), end=(-0.5, -0.25), max_docs=20))


@query(f"WITH {PTS}, {_BW}, g AS (SELECT bw, CAST(ceil(2 / bw) AS INT) + 1 AS w FROM bw), s AS (SELECT bw, w, (w * 6) // 16 AS h, 2.0 / greatest(1, (w * 6) // 16 - 1) AS sx FROM g), v AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, -1 + sx / 2 + i * sx AS px, -1 + bw / 2 + j * bw AS py, bw FROM s, (SELECT unnest(range(500)) AS i), (SELECT unnest(range(500)) AS j) WHERE i < h AND j < w), t AS (SELECT i, j, bw, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d FROM v, pts WHERE abs(x - px) <= bw AND abs(y - py) <= bw), k AS (SELECT i, j, sum(CASE WHEN d < bw THEN 0.75 * (1 - (d / bw) * (d / bw)) ELSE 0 END) AS density FROM t GROUP BY i, j) SELECT i, j, round(coalesce(density, 0), 4) AS density FROM v LEFT JOIN k USING (i, j)")
def kde_neighbours(spark, d):
    """The density of every vertex, gathered from its neighbours."""
    p = points_of(spark, d)
    bw = density.bandwidth(p)
    width, height, sx, sy = density.grid_shape((-1.0, -1.0, 1.0, 1.0), bw)
    cells = spark.range(width * height).select((F.col("id") / width).cast("int").alias("i"), (F.col("id") % width).cast("int").alias("j"))
    vertices = cells.select("i", "j", (F.lit(-1 + sx / 2) + F.col("i") * sx).alias("px"), (F.lit(-1 + sy / 2) + F.col("j") * sy).alias("py"))
    return density.density_of_neighbours(p, vertices, bw).select("i", "j", F.round("density", 4).alias("density"))


# The stored quadtree ------------------------------------------------------------------------------

_ONE = "one AS (SELECT DISTINCT doc_id, node_id, x, y, CASE WHEN NOT isnan(rank) THEN rank END AS rank FROM documents_data WHERE node_id IS NOT NULL)"


def _in_nodes(spark, d) -> DataFrame:
    """(doc_id, node_id, x, y, rank) of the documents that have a node."""
    rows = table(spark, d, "documents_data").where("node_id IS NOT NULL")
    return rows.select("doc_id", "node_id", "x", "y", F.when(~F.isnan("rank"), F.col("rank")).alias("rank")).distinct()


@query(f"WITH {_ONE} SELECT doc_id FROM one WHERE x BETWEEN -0.4 AND 0.3 AND y BETWEEN -0.2 AND 0.6")
def quadtree_rectangle(spark, d):
    return spatial.search_nodes(table(spark, d, "nodes"), _in_nodes(spark, d), (0.3, -0.2), (-0.4, 0.6), first_id=1, y_first=True).select("doc_id")


@query(f"WITH {_ONE} SELECT doc_id FROM one JOIN documents USING (doc_id) WHERE x BETWEEN -0.4 AND 0.3 AND y BETWEEN -0.2 AND 0.6 AND {_has('depth')}")
def quadtree_rectangle_text(spark, d):
    with_text = _in_nodes(spark, d).join(table(spark, d, "documents").select("doc_id", "tsv"), "doc_id")
    return spatial.search_nodes(table(spark, d, "nodes"), with_text, (-0.4, -0.2), (0.3, 0.6), first_id=1, y_first=True, match=text.matches("depth", F.col("tsv"))).select("doc_id")


@query(f"WITH {_ONE} SELECT doc_id FROM one WHERE x BETWEEN -0.4 AND 0.3 AND y BETWEEN -0.2 AND 0.6 AND doc_id IN (SELECT doc_id FROM citations WHERE ref_id = 7)")
def quadtree_by_ids(spark, d):
    ids = table(spark, d, "citations").where("ref_id = 7 AND doc_id IS NOT NULL").select("doc_id")
    return spatial.search_nodes(table(spark, d, "nodes"), _in_nodes(spark, d), (-0.4, -0.2), (0.3, 0.6), first_id=1, y_first=True, ids=ids).select("doc_id")


@query(f"WITH {PTS}, r AS (SELECT doc_id, coalesce(sum(rank) OVER (ORDER BY rank DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pts WHERE rank IS NOT NULL AND x BETWEEN -0.4 AND 0.3 AND y BETWEEN -0.2 AND 0.6) SELECT doc_id FROM r WHERE before < 5.0")
def rank_budget_rectangle(spark, d):
    inside = spatial.in_rectangle(points_of(spark, d, (-0.4, -0.2, 0.3, 0.6)), (-0.4, -0.2), (0.3, 0.6))
    return spatial.rank_budget(inside, 5.0).select("doc_id")


@query(f"WITH {_ONE}, big AS (SELECT node_id FROM one GROUP BY node_id ORDER BY count(*) DESC, node_id LIMIT 1), r AS (SELECT doc_id, row_number() OVER (ORDER BY rank DESC NULLS LAST, doc_id) AS k FROM one WHERE node_id = (SELECT node_id FROM big)) SELECT doc_id FROM r WHERE k BETWEEN 3 AND 4")
def node_page(spark, d):
    """The second page of two of the fullest node."""
    rows = _in_nodes(spark, d)
    full = rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node_id").first()
    return spatial.node_page(rows, full["node_id"] if full else -1, 2, 1).select("doc_id")


@query("SELECT node_id, isleaf, parent_id, depth, index, row_number() OVER (ORDER BY node_id) - 1 AS place FROM nodes")
def nodes_saved(spark, d):
    """The tree written in breadth-first order and read again."""
    path = shared_folder(spark, "nodes")
    spatial.write_nodes(table(spark, d, "nodes"), path)
    return numbered(spatial.read_nodes(spark, path), "node_id", "place").select("node_id", "isleaf", "parent_id", "depth", "index", "place")


@query(f"WITH {PTS}, k AS (SELECT doc_id, greatest(least(CAST(floor((x + 1) * 8) AS BIGINT), 15), 0) AS cx, greatest(least(CAST(floor((y + 1) * 8) AS BIGINT), 15), 0) AS cy FROM pts) SELECT doc_id, 1 + 85 + " + " + ".join(f"((((cy >> {b}) & 1) * 2 + ((cx >> {b}) & 1)) * {4**b})" for b in range(4)) + " AS node_id FROM k")
def leaf_of_place(spark, d):
    return spatial.find_leaf(table(spark, d, "nodes"), points_of(spark, d), 4, first_id=1, y_first=True).select("doc_id", "node_id")


# Vectors from text --------------------------------------------------------------------------------

_KEPT = "list_filter(list_zip({c}, range(1, len({c}) + 1)), lambda e: e[1] NOT IN " + _STOP + ")"
_VECTOR = (
    "tok AS (SELECT doc_id, " + ", ".join(f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+') AS {c}" for c in ("title", "keywords", "abstract")) + " FROM documents), "
    "kept AS (SELECT doc_id, " + ", ".join(f"{_KEPT.format(c=c)} AS {c}" for c in ("title", "keywords", "abstract")) + " FROM tok), "
    "ends AS (SELECT *, coalesce(list_max(list_transform(title, lambda e: e[2])), 0) AS t, coalesce(list_max(list_transform(keywords, lambda e: e[2])), 0) AS k FROM kept), "
    "places AS (SELECT doc_id, unnest(title) AS e, 0 AS shift, 'A' AS weight FROM ends UNION ALL SELECT doc_id, unnest(keywords), t, 'B' FROM ends UNION ALL SELECT doc_id, unnest(abstract), t + k, 'C' FROM ends), "
    "vec AS (SELECT doc_id, e[1] AS word, CAST(e[2] + shift AS INT) AS pos, weight FROM places)"
)


@query(f"WITH {_VECTOR} SELECT doc_id, word, pos, weight FROM vec")
def document_vectors(spark, d):
    """Vectors of title, keywords and abstract, unstemmed, in long form."""
    long = text.postings(text.build_vectors(table(spark, d, "documents")))
    return long.select("doc_id", "word", F.explode("positions").alias("p")).select("doc_id", "word", "p.pos", "p.weight")


@query(f"WITH {_VECTOR}, c AS (SELECT doc_id, word, count(*) AS n FROM vec GROUP BY ALL) SELECT doc_id, word, CAST(n AS INT) AS nentry, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) - 1 AS INT) AS place FROM c")
def document_freqs(spark, d):
    """Word counts of those vectors, most frequent first, with their place in the stored list."""
    stored = text.build_vectors(table(spark, d, "documents")).select("doc_id", F.to_json("freqs").alias("json"))
    return stored.select("doc_id", F.posexplode(text.stored_counts(F.col("json"))).alias("place", "e")).select("doc_id", "e.word", "e.nentry", "place")


@query(f"SELECT doc_id FROM documents WHERE CASE WHEN coalesce(lower(trim(lang)) IN ('english', 'en', 'eng', 'en_xx'), FALSE) THEN {_has('depth')} ELSE {_has('depths')} END")
def search_by_language(spark, d):
    """The query's words stemmed for English documents only."""
    return table(spark, d, "documents").where(text.matches_in("depths", F.col("tsv"), F.col("lang"))).select("doc_id")


@query("WITH b AS (SELECT doc_id, container_issn, tsv FROM documents WHERE container_issn IS NOT NULL AND tsv IS NOT NULL), p AS (SELECT doc_id, container_issn, e.key AS word, unnest(e.value).pos AS pos FROM (SELECT doc_id, container_issn, unnest(map_entries(tsv)) AS e FROM b)), m AS (SELECT doc_id, container_issn, coalesce(max(pos), 0) AS n FROM b LEFT JOIN p USING (doc_id, container_issn) GROUP BY ALL), s AS (SELECT doc_id, coalesce(sum(n) OVER (PARTITION BY container_issn ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM m) SELECT container_issn, word, count(*) AS n, CAST(sum(pos + shift) AS BIGINT) AS places FROM p JOIN s USING (doc_id) GROUP BY ALL")
def folded_vectors(spark, d):
    """One vector a journal, its documents' vectors one behind the other."""
    rows = text.folded_vectors(table(spark, d, "documents").where("container_issn IS NOT NULL AND tsv IS NOT NULL"), "container_issn", "doc_id")
    long = rows.select("container_issn", F.explode("tsv").alias("word", "places"))
    return long.select("container_issn", "word", F.size("places").cast("long").alias("n"), F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p["pos"]).alias("places"))


@query("WITH w AS (SELECT aut_id, unnest(regexp_extract_all(lower(aut_name), '[\\p{L}\\p{N}]+')) AS w FROM authors), p AS (SELECT aut_id, '  ' || w || ' ' AS w FROM w), t AS (SELECT DISTINCT aut_id, substr(w, CAST(i AS BIGINT), 3) AS t FROM (SELECT aut_id, w, unnest(range(1, length(w) - 1)) AS i FROM p)) SELECT aut_id, t AS piece FROM t")
def author_trigrams(spark, d):
    return table(spark, d, "authors").select("aut_id", F.explode(text.trigrams(F.col("aut_name"))).alias("piece"))


# Term matrix --------------------------------------------------------------------------------------


@query(f"WITH sel AS (SELECT * FROM documents WHERE enabled), e AS (SELECT doc_id, unnest(map_entries(tsv)) AS e FROM sel), st AS (SELECT e.key AS word, CAST(count(*) AS DOUBLE) AS ndoc FROM e GROUP BY 1 HAVING count(*) > 5 AND count(*) < 200), t AS (SELECT doc_id, word, sum(CASE q.weight WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.4 WHEN 'C' THEN 0.2 ELSE 0.1 END) AS f FROM (SELECT doc_id, e.key AS word, unnest(e.value) AS q FROM e) GROUP BY ALL), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM sel), w AS (SELECT doc_id, word, {_SCHEME_SQL[2]} AS weight FROM t JOIN st USING (word), c) SELECT doc_id, word, round(weight, 6) AS weight FROM w WHERE weight <> 0")
def term_matrix(spark, d):
    """The term matrix of the enabled documents over words of 6 to 199 of them."""
    docs = table(spark, d, "documents")
    return termmatrix.term_matrix(docs, 2, docs.where("enabled"), ndoc=(5, 200)).select("doc_id", "word", F.round("weight", 6).alias("weight"))


@query("WITH t AS (SELECT doc_id, e.word AS word, 1 + 2 * ln(e.nentry) AS weight FROM (SELECT doc_id, unnest(freqs) AS e FROM documents) WHERE e.nentry > 0), m AS (SELECT doc_id, word, sum(weight) AS weight FROM t GROUP BY ALL), n AS (SELECT doc_id, sum(weight * weight) AS n FROM m GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.weight * b.weight) AS dot FROM m a JOIN m b USING (word) WHERE a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL) SELECT a, b, round(1 - greatest(least(dot / sqrt(x.n) / sqrt(y.n), 1), -1), 6) AS distance FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b")
def sparse_cosine(spark, d):
    """Cosine dissimilarity of sparse rows: every document with an id divisible by 50 against all that share a word with it."""
    m = termmatrix.frequency_rows(table(spark, d, "documents"))
    got = termmatrix.sparse_products(m.where("doc_id % 50 = 0"), m, termmatrix.cosine_distance).where("a <> b")
    return got.select("a", "b", F.col("value").alias("distance"))


@query()
def project_documents(spark, d):
    """From texts to places: term matrix, control points, affine maps, outliers off, scaling."""
    return projection.project_documents(table(spark, d, "documents"))
