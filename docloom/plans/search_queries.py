"""Registered queries: ranking, hybrid search, facets, suggestions, evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from docloom.functions.citations import map_citations
from docloom.functions.vectors import mean_vectors, unit
from docloom.operators import answer, cells, evaluation, phrases, retrieval, suggest
from docloom.operators.access import Filters, search_filter
from docloom.operators.enrich import centroid_suggestions, tag_centroids
from docloom.operators.topk import batch_topk, cosine_queries
from docloom.plans import sqltext
from docloom.plans.corpus import (
    CATALOGUE_SQL, DOCUMENT_TAGS_SQL, GROUPS, GROUPS_SQL, VECTOR_DIM, benchmark_queries, catalogue, document_tags, search_index, stored_index, stored_titles,
)
from docloom.plans.registry import register
from docloom.session import cut_lineage, shared_folder
from docloom.settings import DEFAULTS
from docloom.sources import inverted, title_store
from docloom.sources.tables import table

# --- vectors -----------------------------------------------------------------

_CENTROIDS_SQL = """
parts AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(x) AS m FROM parts GROUP BY ALL),
norms AS (SELECT label, sqrt(sum(m * m)) AS n FROM means GROUP BY label),
units AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM parts)
"""


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


@register("mean_embedding", f"WITH {_CENTROIDS_SQL} SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(m, 6) AS value FROM means")
def mean_embedding(spark, folder):
    means = mean_vectors(_vectors(spark, folder), ["label"], "embedding")
    return means.select("label", F.posexplode("mean_vector").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("value"))


@register("tag_centroids", f"WITH {_CENTROIDS_SQL} SELECT label AS tag_id, CAST(i - 1 AS INTEGER) AS pos, round(m / n, 6) AS value FROM means JOIN norms USING (label)")
def centroids(spark, folder):
    vectors = _vectors(spark, folder)
    links = vectors.select(F.col("label").alias("tag_id"), F.col("vec_id").alias("document_id"))
    made = tag_centroids(links, vectors.select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector")))
    return made.select("tag_id", F.posexplode("centroid").alias("pos", "v")).select("tag_id", "pos", F.round("v", 6).alias("value"))


_KNN_TOPK_SQL = f"""
WITH {_CENTROIDS_SQL},
sims AS (SELECT m.label AS query_id, u.vec_id AS id, round(sum(u.x * m.m / n), 9) AS score FROM units u JOIN means m ON m.i = u.i JOIN norms USING (label) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sims)
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 50
"""


@register("knn_topk", _KNN_TOPK_SQL)
def knn_topk(spark, folder):
    """The 50 vectors nearest to the mean of each label."""
    vectors = _vectors(spark, folder)
    queries = mean_vectors(vectors, ["label"], "embedding").select("label", "mean_vector")
    return batch_topk(vectors.select("vec_id", "embedding"), queries, cosine_queries, DEFAULTS.knn_k, None)


@register("knn_cells", _KNN_TOPK_SQL)
def knn_cells(spark, folder):
    """The same from cells around pivots, of which only those that can hold a near vector are read."""
    vectors = _vectors(spark, folder)
    queries = mean_vectors(vectors, ["label"], "embedding").select(F.col("label").alias("query_id"), F.col("mean_vector").alias("vector"))
    place = f"{shared_folder(spark)}/cells"
    cells.build(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), place)
    return cells.nearest(spark, place, queries, DEFAULTS.knn_k)[0]


@register(
    "tag_suggestions",
    f"""
WITH {_CENTROIDS_SQL},
sims AS (
  SELECT u.vec_id AS document_id, m.label AS tag_id, round(sum(u.x * m.m / n), 6) AS similarity
  FROM units u JOIN means m ON m.i = u.i JOIN norms n ON n.label = m.label JOIN embeddings e ON e.vec_id = u.vec_id
  WHERE m.label >= 8 OR m.label % 4 = u.vec_id % 4 GROUP BY ALL)
SELECT * FROM sims WHERE similarity >= 0.05
""",
)
def tag_suggestions(spark, folder):
    """Tags 0-7 belong to one of four departments, tags 8 and 9 to all; the given vectors are far apart, so the bar is low."""
    vectors = _vectors(spark, folder)
    department = F.concat(F.lit("d"), F.pmod("vec_id", F.lit(4)).cast("string"))
    documents = vectors.select(F.col("vec_id").alias("document_id"), department.alias("department_id"), F.col("embedding").alias("vector"))
    means = mean_vectors(vectors, ["label"], "embedding").select(F.col("label").alias("tag_id"), unit(F.col("mean_vector")).alias("centroid"))
    owner = F.when(F.col("tag_id") < 8, F.concat(F.lit("d"), F.pmod("tag_id", F.lit(4)).cast("string")))
    return centroid_suggestions(documents, means.withColumn("department_id", owner), replace(DEFAULTS, tag_similarity_threshold=0.05))


# --- lexical and hybrid ------------------------------------------------------

_VISIBLE = f"department_id IN {GROUPS_SQL}"
_FILTERED = f"{_VISIBLE} AND doctype IN ('policy','report') AND effective_date BETWEEN '2023-02-01' AND '2025-06-30' AND superseded_by IS NULL"


def _bm25_sql(source: str = "benchmark", key: str = "item_id", text: str = "text", visible: str = _VISIBLE) -> str:
    """CTEs up to ``bm25(query_id, id, score, rank)`` with title boosted three times."""
    return f"""
toks AS (
  SELECT document_id, 0 AS field, unnest({sqltext.terms('title')}) AS term FROM cat
  UNION ALL SELECT document_id, 1, unnest({sqltext.terms('text')}) FROM cat),
lens AS (SELECT document_id, field, count(*) AS dl FROM toks GROUP BY ALL),
stats AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY field),
tfs AS (SELECT document_id, field, term, count(*) AS tf FROM toks GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df FROM tfs GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT {key} AS query_id, unnest({sqltext.terms(text)}) AS term FROM {source}) GROUP BY ALL),
parts AS (
  SELECT q.query_id, t.document_id AS id, t.field,
    sum(CASE t.field WHEN 0 THEN 3.0 ELSE 1.0 END::DOUBLE * q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf / (t.tf + 1.2 * (1 - 0.75 + 0.75 * l.dl / s.avgdl))) AS score
  FROM qt q JOIN tfs t ON t.term = q.term JOIN dfs d ON d.field = t.field AND d.term = t.term JOIN stats s ON s.field = t.field
    JOIN lens l ON l.document_id = t.document_id AND l.field = t.field GROUP BY ALL),
best AS (SELECT query_id, id, round(max(score), 9) AS score FROM parts WHERE id IN (SELECT document_id FROM cat WHERE {visible}) GROUP BY ALL),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM best WHERE score > 0) WHERE rank <= 50)
"""


def _knn_sql(visible: str = _VISIBLE) -> str:
    return f"""
{sqltext.embedding('cat', 'document_id', 'text', prefix='d')},
{sqltext.embedding('benchmark', 'item_id', sqltext.normalize('text'), prefix='q')},
sims AS (
  SELECT q.item_id AS query_id, d.document_id AS id, round(coalesce(v.s, 0), 9) AS score
  FROM (SELECT item_id FROM benchmark) q CROSS JOIN (SELECT document_id FROM cat WHERE {visible}) d
  LEFT JOIN (SELECT a.k AS qk, b.k AS dk, sum(a.x * b.x) AS s FROM qvec a JOIN dvec b USING (slot) GROUP BY ALL) v ON v.qk = q.item_id AND v.dk = d.document_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sims) WHERE rank <= 50)
"""


_FUSE_SQL = """
ranks AS (SELECT query_id, id, rank, 0 AS list FROM knn UNION ALL SELECT query_id, id, rank, 1 FROM bm25),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list * 1000 + rank) AS seen FROM ranks GROUP BY ALL),
pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, id) AS position FROM fused),
guarded AS (
  SELECT p.query_id, p.id AS document_id, p.position, CASE WHEN c.superseded_by IS NOT NULL THEN p.score * 0.7 ELSE p.score END AS score,
    c.title, c.doctype, c.department_id, c.text
  FROM pos p JOIN cat c ON c.document_id = p.id WHERE c.deleted_at IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, position) AS rank FROM guarded)
"""

_HYBRID_SQL = f"WITH {CATALOGUE_SQL}, {_bm25_sql()}, {_knn_sql()}, {_FUSE_SQL}"


def _analyzed(spark, folder):
    return retrieval.analyze_index(search_index(spark, folder))


def _queries(spark, folder):
    return retrieval.embed_queries(benchmark_queries(spark, folder), VECTOR_DIM)


def _stored_topk(spark, folder, queries, visible=None, fuzzy=False):
    place = stored_index(spark, folder)
    found = inverted.topk(spark, place, queries, GROUPS, DEFAULTS.bm25_size, visible, fuzzy)
    if found is None:  # too many query terms to be sent to every task: both sides are cut into blocks
        return retrieval.lexical_topk(_analyzed(spark, folder), search_filter(GROUPS) if visible is None else visible, queries, DEFAULTS.bm25_size, fuzzy)
    return found.select("query_id", F.col("document_id").alias("id"), "score", "rank")


@register("bm25_topk", f"WITH {CATALOGUE_SQL}, {_bm25_sql()} SELECT query_id, id, round(score, 6) AS score, rank FROM bm25")
def bm25_topk(spark, folder):
    return retrieval.lexical_topk(_analyzed(spark, folder), search_filter(GROUPS), benchmark_queries(spark, folder), DEFAULTS.bm25_size)


@register("bm25_stored", f"WITH {CATALOGUE_SQL}, {_bm25_sql()} SELECT query_id, id, round(score, 6) AS score, rank FROM bm25")
def bm25_stored(spark, folder):
    """From the stored postings: no text is read but the queries' own."""
    return _stored_topk(spark, folder, benchmark_queries(spark, folder))


@register(
    "bm25_stored_filtered",
    f"WITH {CATALOGUE_SQL}, {_bm25_sql(visible=_FILTERED)} SELECT query_id, id, round(score, 6) AS score, rank FROM bm25",
)
def bm25_stored_filtered(spark, folder):
    """The same under further filters, which hold before the best are chosen."""
    visible = search_filter(GROUPS, Filters(doctype=["policy", "report"], date_from="2023-02-01", date_to="2025-06-30", include_superseded=False))
    return _stored_topk(spark, folder, benchmark_queries(spark, folder), visible)


# The checker counts edits in bytes; one capital letter per accented letter makes that the same as characters.
_ONE_BYTE = "translate({t}, 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿßœæ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&')"
_FUZZY_FROM = "(SELECT n_nationkey AS query_id, 'ther ' || n_name || ' thion' AS query FROM nation UNION ALL SELECT 100 + r_regionkey, r_name || ' meant eaux' FROM region)"


_FUZZY_SQL = f"""
WITH {CATALOGUE_SQL},
asked AS {_FUZZY_FROM}, {_bm25_sql('asked', 'query_id', 'query')},
limits AS (SELECT DISTINCT term, CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS lim FROM qt),
near AS (
  SELECT l.term AS asked, v.term, levenshtein({_ONE_BYTE.format(t='l.term')}, {_ONE_BYTE.format(t='v.term')}) AS distance FROM limits l JOIN (SELECT DISTINCT term FROM dfs) v
  ON abs(length(l.term) - length(v.term)) <= l.lim AND levenshtein({_ONE_BYTE.format(t='l.term')}, {_ONE_BYTE.format(t='v.term')}) <= l.lim),
wide AS (SELECT q.query_id, n.term, sum(q.qtf * (1 - n.distance / least(length(n.asked), length(n.term))::DOUBLE)) AS qtf FROM qt q JOIN near n ON n.asked = q.term GROUP BY ALL),
fparts AS (
  SELECT q.query_id, t.document_id AS id, t.field,
    sum(CASE t.field WHEN 0 THEN 3.0 ELSE 1.0 END::DOUBLE * q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf / (t.tf + 1.2 * (1 - 0.75 + 0.75 * l.dl / s.avgdl))) AS score
  FROM wide q JOIN tfs t ON t.term = q.term JOIN dfs d ON d.field = t.field AND d.term = t.term JOIN stats s ON s.field = t.field
    JOIN lens l ON l.document_id = t.document_id AND l.field = t.field GROUP BY ALL),
fbest AS (SELECT query_id, id, round(max(score), 9) AS score FROM fparts WHERE id IN (SELECT document_id FROM cat WHERE {_VISIBLE}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fbest WHERE score > 0)
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 50
"""


@register("bm25_fuzzy", _FUZZY_SQL)
def bm25_fuzzy(spark, folder):
    """Place names framed by misspelt words, every word matched within its automatic edit distance."""
    return retrieval.lexical_topk(_analyzed(spark, folder), search_filter(GROUPS), _misspelt(spark, folder), DEFAULTS.bm25_size, fuzzy=True)


def _misspelt(spark, folder):
    nations = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("query_id"), F.concat(F.lit("ther "), F.col("n_name"), F.lit(" thion")).alias("query")
    )
    regions = table(spark, folder, "region").select((F.col("r_regionkey") + 100).alias("query_id"), F.concat(F.col("r_name"), F.lit(" meant eaux")).alias("query"))
    return nations.unionByName(regions)


@register("bm25_stored_fuzzy", _FUZZY_SQL)
def bm25_stored_fuzzy(spark, folder):
    """Near spellings come from the stored vocabulary."""
    return _stored_topk(spark, folder, _misspelt(spark, folder), fuzzy=True)


@register("knn_documents", f"WITH {CATALOGUE_SQL}, {_knn_sql(_FILTERED)} SELECT query_id, id, round(score, 6) AS score, rank FROM knn")
def knn_documents(spark, folder):
    """Exact vector search under access, type, date and succession filters."""
    filters = Filters(doctype=["policy", "report"], date_from="2023-02-01", date_to="2025-06-30", include_superseded=False)
    index, queries = search_index(spark, folder), _queries(spark, folder).select("query_id", "vector")
    return retrieval.vector_topk(index, search_filter(GROUPS, filters, True), queries, DEFAULTS.knn_k)


@register(
    "rrf_fusion",
    """
WITH a AS (SELECT o_orderpriority AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
b AS (SELECT o_orderpriority AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey DESC) AS rank FROM orders WHERE o_orderstatus = 'F'),
u AS (SELECT *, 0 AS list FROM a WHERE rank <= 50 UNION ALL SELECT *, 1 FROM b WHERE rank <= 50),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(list * 1000 + rank) AS seen FROM u GROUP BY ALL)
SELECT query_id, id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, seen, id) AS position FROM f
""",
)
def rrf_fusion(spark, folder):
    """Two rankings of orders per priority: all by price, and the finished ones by price."""
    from docloom.functions.skew import top_per_key

    orders = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    price = F.col("o_totalprice").desc()
    first = top_per_key(orders, ["query_id"], [price, F.col("id")], 50)
    second = top_per_key(orders.where("o_orderstatus = 'F'"), ["query_id"], [price, F.col("id").desc()], 50)
    return retrieval.fuse([first, second]).withColumn("score", F.round("score", 9))


_SNIPPET_SQL = r"""
words AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark),
cut AS (
  SELECT r.*, b.id IS NOT NULL AS lexical, w.w, regexp_extract_all(r.text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS pieces
  FROM ranked r LEFT JOIN bm25 b ON b.query_id = r.query_id AND b.id = r.document_id JOIN words w ON w.query_id = r.query_id),
found AS (SELECT *, list_position(list_transform(pieces, lambda p: list_contains(w, lower(p))), true) AS hit_at FROM cut),
frag AS (SELECT *, substr(text, CAST(length(array_to_string(pieces[1:hit_at-1], '')) + 1 AS BIGINT), 180) AS fragment FROM found),
marked AS (
  SELECT *, CASE WHEN lexical AND hit_at > 0 THEN array_to_string(list_transform(regexp_extract_all(fragment, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'),
    lambda p: CASE WHEN list_contains(w, lower(p)) THEN '<mark>' || p || '</mark>' ELSE p END), '') END AS highlight FROM frag)
"""


@register(
    "hybrid_search",
    f"""
{_HYBRID_SQL}, {_SNIPPET_SQL}
SELECT query_id, rank, document_id, title, doctype, round(score, 9) AS score, coalesce(highlight, substr(text, 1, 240)) AS snippet FROM marked WHERE rank <= 10
""",
)
def hybrid_search(spark, folder):
    """First result page of every benchmark passage: fused, guarded, re-ranked, with marked snippets."""
    page = retrieval.search(_analyzed(spark, folder), catalogue(spark, folder), document_tags(spark, folder), _queries(spark, folder), GROUPS).results
    return page.select("query_id", "rank", "document_id", "title", "doctype", F.round("score", 9).alias("score"), "snippet")


@register(
    "hybrid_retrieve",
    f"{_HYBRID_SQL} SELECT query_id, rank, document_id, round(score, 9) AS score FROM ranked WHERE rank <= 8",
)
def hybrid_retrieve(spark, folder):
    hits = retrieval.retrieve(_analyzed(spark, folder), catalogue(spark, folder), _queries(spark, folder), GROUPS)
    return hits.select("query_id", "rank", "document_id", F.round("score", 9).alias("score"))


@register(
    "search_facets",
    f"""
{_HYBRID_SQL}, {DOCUMENT_TAGS_SQL},
vals AS (
  SELECT query_id, 'doctype' AS facet, doctype AS value FROM ranked UNION ALL SELECT query_id, 'department_id', department_id FROM ranked
  UNION ALL SELECT r.query_id, 'tags', t.tag_name FROM ranked r JOIN (SELECT DISTINCT * FROM doc_tags) t USING (document_id)),
n AS (SELECT query_id, facet, value, count(*) AS n FROM vals GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id, facet ORDER BY n DESC, value) AS position FROM n
""",
)
def search_facets(spark, folder):
    found = retrieval.search(_analyzed(spark, folder), catalogue(spark, folder), document_tags(spark, folder), _queries(spark, folder), GROUPS)
    return found.facets


@register(
    "search_totals",
    f"""
{_HYBRID_SQL}
SELECT query_id, count(*) AS total, count(*) FILTER (WHERE department_id NOT IN {GROUPS_SQL}) AS leaked FROM ranked GROUP BY query_id
""",
)
def search_totals(spark, folder):
    """How much each query finds, and how much of it the caller must not see (always none)."""
    cat = catalogue(spark, folder)
    best = retrieval.best_per_document(retrieval.hybrid(_analyzed(spark, folder), _queries(spark, folder), GROUPS))
    found = retrieval.hydrate(best, cat, GROUPS, DEFAULTS.superseded_penalty)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("department_id").isin(GROUPS)).alias("leaked"))


@register(
    "passage_headers",
    f"""
{_HYBRID_SQL}
SELECT r.query_id, r.rank, r.document_id,
  '[' || r.rank || '] ' || r.title || ' | document_id=' || r.document_id || ' | type=' || r.doctype || ' | page=1 | effective=' || c.effective_date ||
  CASE WHEN c.superseded_by IS NOT NULL THEN ' | SUPERSEDED by ''' || coalesce(n.title, 'a newer document') || ''' (' || c.superseded_by || ')' ELSE '' END AS header
FROM ranked r JOIN cat c ON c.document_id = r.document_id LEFT JOIN cat n ON n.document_id = c.superseded_by AND n.deleted_at IS NULL AND n.department_id IN {GROUPS_SQL}
WHERE r.rank <= 6
""",
)
def passage_headers(spark, folder):
    """What the search tool shows for each passage, header line only."""
    cat = catalogue(spark, folder)
    hits = retrieval.retrieve(_analyzed(spark, folder), cat, _queries(spark, folder), GROUPS, 6).drop("superseded_by")
    shown = answer.passage_headers(hits, cat, GROUPS)
    return shown.select("query_id", "rank", "document_id", F.substring_index("passage", "\n", 1).alias("header"))


@register(
    "answer_citations",
    f"""
{_HYBRID_SQL},
marks AS (SELECT item_id AS query_id, unnest([2, 99, 1]) AS n, unnest([0, 1, 2]) AS position FROM benchmark WHERE item_id % 2 = 0
  UNION ALL SELECT item_id, unnest([1, 2, 3]), unnest([0, 1, 2]) FROM benchmark WHERE item_id % 2 = 1)
SELECT m.query_id, m.position, m.n, r.document_id, r.title, substr(r.text, 1, 300) AS quote FROM marks m JOIN ranked r ON r.query_id = m.query_id AND r.rank = m.n WHERE r.rank <= 8
""",
)
def answer_citations(spark, folder):
    """Even queries cite [2][99][1] (99 drops out); odd ones cite nothing and get their first three sources."""
    hits = retrieval.retrieve(_analyzed(spark, folder), catalogue(spark, folder), _queries(spark, folder), GROUPS)
    text = F.when(F.pmod("query_id", F.lit(2)) == 0, "As stated [2], [99] and again [2, 1].").otherwise("No idea.")
    answers = benchmark_queries(spark, folder).select("query_id", text.alias("answer"))
    return map_citations(answers, hits).select("query_id", "position", "n", "document_id", "title", "quote")


@register(
    "eval_hit_rate",
    f"""
WITH {CATALOGUE_SQL}, {_bm25_sql()}, {_knn_sql()}, {_FUSE_SQL},
expected AS (SELECT b.item_id AS query_id, c.document_id, CASE WHEN length(b.text) < 250 THEN 'short' ELSE 'long' END AS category
  FROM benchmark b JOIN cat c ON contains(c.text, b.text) WHERE c.department_id IN {GROUPS_SQL} AND c.deleted_at IS NULL),
found AS (SELECT e.query_id, min(e.category) AS category, max(CASE WHEN r.rank <= 5 THEN 1 ELSE 0 END) AS hit
  FROM expected e LEFT JOIN ranked r ON r.query_id = e.query_id AND r.document_id = e.document_id GROUP BY e.query_id)
SELECT coalesce(category, 'overall') AS category, sum(hit)::BIGINT AS hits, count(*) AS total, round(sum(hit) / count(*), 6) AS rate, round(sum(hit) / count(*), 6) >= 0.9 AS passed
FROM found GROUP BY ROLLUP (category)
""",
)
def eval_hit_rate(spark, folder):
    """Benchmark passages are planted in documents: is a document holding the passage among the first five?"""
    cat = catalogue(spark, folder)
    hits = retrieval.retrieve(_analyzed(spark, folder), cat, _queries(spark, folder), GROUPS, evaluation.TOP)
    return evaluation.hit_rates(evaluation.hits(hits, planted(spark, folder)))


def planted(spark, folder):
    """``(query_id, document_id, category)``: readable documents containing the whole passage."""
    visible = catalogue(spark, folder).where(F.col("deleted_at").isNull() & F.col("department_id").isin(GROUPS)).select("document_id", "text")
    checked = evaluation.containing(visible, table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")))
    category = F.when(F.length("passage") < 250, "short").otherwise("long")
    return checked.select("query_id", "document_id", category.alias("category")).distinct()


# --- suggestions -------------------------------------------------------------

TYPED = ("the", "la ment", "thion ond", "en")

_FOLD = "replace(replace(replace(translate(lower({t}), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"


def _suggest_sql(text: str) -> str:
    w = sqltext.terms(_FOLD.format(t="title"))
    a = sqltext.terms(_FOLD.format(t=f"'{text}'"))
    return f"""
SELECT '{text}' AS typed, document_id, title, doctype, tags_hint, round(
  CASE WHEN title = '{text}' THEN 10.0 ELSE 0.0 END
  + CASE WHEN len(w) >= len(a) AND len(list_filter(range(1, greatest(len(w) - len(a) + 2, 2)), lambda i:
      w[i:i+len(a)-2] = a[1:len(a)-1] AND starts_with(coalesce(w[i+len(a)-1], ''), a[-1]))) > 0 THEN 6.0 ELSE 0.0 END
  + 3.0 * len(list_filter(a, lambda t: len(list_filter(w, lambda x: starts_with(x, t) AND length(t) BETWEEN 2 AND 20)) > 0)) / len(a)
  + CASE WHEN len(g) > 0 AND len(list_filter(g, lambda t: list_contains(tg, t))) / len(g) >= 0.7 THEN len(list_filter(g, lambda t: list_contains(tg, t))) / len(g) ELSE 0.0 END
  + 0.5 * len(list_filter(a, lambda t: len(list_filter(w, lambda x: starts_with(x, substr(t, 1, 2)) AND levenshtein(x, t) <= CASE WHEN length(t) <= 2 THEN 0 WHEN length(t) <= 5 THEN 1 ELSE 2 END)) > 0)) / len(a)
  + 2.0 * len(list_filter(c, lambda t: list_contains(tc, t))) / len(c), 6) AS score
FROM (
  SELECT *, {w} AS w, {a} AS a, {sqltext.terms(f"'{text}'")} AS c, {sqltext.terms('title')} AS tc,
    list_distinct(flatten(list_transform({a}, lambda t: list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))))) AS g,
    list_distinct(flatten(list_transform({w}, lambda t: list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))))) AS tg,
    language AS tags_hint
  FROM cat WHERE deleted_at IS NULL AND department_id IN {GROUPS_SQL})
"""


def _titles(spark, folder):
    cat = catalogue(spark, folder).where(F.col("deleted_at").isNull())
    return suggest.title_index(cat.select("document_id", "title", "doctype", "department_id", F.array("department_id").alias("allowed_groups"), F.array("language").alias("tags")))


_ALL_TYPED_SQL = " UNION ALL ".join(f"({_suggest_sql(t)})" for t in TYPED)


@register(
    "suggest_titles",
    f"""
WITH {CATALOGUE_SQL}, s AS ({_ALL_TYPED_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY score DESC, document_id) AS n FROM s WHERE score > 0)
SELECT typed, document_id, title, doctype, CAST(score AS DOUBLE) AS score FROM r WHERE n <= 8
""",
)
def suggest_titles(spark, folder):
    """All typed texts in one pass over the stored words of the titles."""
    found = title_store.suggest(spark, stored_titles(spark, folder), list(TYPED), GROUPS)
    return found.select("typed", "document_id", "title", "doctype", "score")


@register(
    "suggest_tags",
    f"""
WITH {CATALOGUE_SQL}, s AS ({_ALL_TYPED_SQL}), tags AS (SELECT row_number() OVER (ORDER BY l) AS tag_id, l AS name FROM (SELECT DISTINCT lang AS l FROM documents)),
agg AS (SELECT typed, tags_hint AS name, count(*) AS n FROM s WHERE score > 0 GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY n DESC, name) AS k FROM agg) WHERE k <= 5),
typed AS (SELECT unnest({list(TYPED)}) AS typed),
tiers AS (
  SELECT typed, name, 0 AS tier, -n AS weight FROM top WHERE contains(name, typed) UNION ALL
  SELECT typed, name, 1, 0 FROM typed, tags WHERE contains(name, typed) UNION ALL SELECT typed, name, 2, -n FROM top),
firsts AS (SELECT typed, name, min((tier, weight, name)) AS place FROM tiers GROUP BY ALL),
r AS (SELECT f.typed, t.name, row_number() OVER (PARTITION BY f.typed ORDER BY place) AS position FROM firsts f JOIN tags t ON t.name = f.name)
SELECT typed, name, position FROM r WHERE position <= 5
""",
)
def suggest_tags(spark, folder):
    """Tags here are the document languages."""
    from pyspark.sql.window import Window

    links = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("tag_name"))
    names = table(spark, folder, "documents").select(F.col("lang").alias("name")).distinct()
    tags = names.withColumn("tag_id", F.row_number().over(Window.orderBy("name")))
    frequent = cut_lineage(title_store.tags_of_matches(spark, stored_titles(spark, folder), list(TYPED), GROUPS, links))
    merged = None
    for place, text in enumerate(TYPED):
        part = suggest.ordered_tags(frequent.where(F.col("typed") == place).select("name", "n"), tags, text).select(F.lit(text).alias("typed"), F.col("name"), (F.monotonically_increasing_id() + 1).alias("position"))
        merged = part if merged is None else merged.unionByName(part)
    return merged


@register(
    "did_you_mean",
    f"""
WITH {CATALOGUE_SQL},
asked AS {_FUZZY_FROM},
vocab AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT document_id, unnest({sqltext.terms(_FOLD.format(t='title'))}) AS term FROM cat WHERE deleted_at IS NULL AND department_id IN {GROUPS_SQL}) GROUP BY term),
qw AS (SELECT query_id, query, unnest(w) AS asked, generate_subscripts(w, 1) AS pos FROM (SELECT *, {sqltext.terms(_FOLD.format(t='query'))} AS w FROM asked)),
near AS (
  SELECT a.asked, v.term, row_number() OVER (PARTITION BY a.asked ORDER BY levenshtein(a.asked, v.term), df DESC, v.term) AS n
  FROM (SELECT DISTINCT asked FROM qw) a JOIN vocab v ON levenshtein(a.asked, v.term) <= CASE WHEN length(a.asked) <= 2 THEN 0 WHEN length(a.asked) <= 5 THEN 1 ELSE 2 END),
done AS (SELECT q.query_id, q.query, string_agg(coalesce(n.term, q.asked), ' ' ORDER BY pos) AS suggestion, count(n.term) AS known
  FROM qw q LEFT JOIN near n ON n.asked = q.asked AND n.n = 1 GROUP BY ALL)
SELECT query_id, suggestion FROM done WHERE known > 0 AND suggestion <> lower(query)
""",
)
def did_you_mean(spark, folder):
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("ther "), F.col("n_name"), F.lit(" thion")).alias("query"))
    regions = table(spark, folder, "region").select((F.col("r_regionkey") + 100).alias("query_id"), F.concat(F.col("r_name"), F.lit(" meant eaux")).alias("query"))
    return suggest.did_you_mean(_titles(spark, folder), nations.unionByName(regions), GROUPS)



_TITLE_WORDS = sqltext.terms(_FOLD.format(t="title"))
_DROPPED = f"""
asked AS (SELECT document_id AS query_id, array_to_string(list_transform(w[1:4], lambda x: CASE WHEN length(x) > 4 THEN substr(x, 1, 2) || substr(x, 4) ELSE x END), ' ') AS query
  FROM (SELECT document_id, {_TITLE_WORDS} AS w FROM cat) WHERE document_id % 100 = 0)"""


def _dropped_letters(spark, folder):
    """The first four words of every hundredth title, long words without their third letter."""
    words = F.slice(suggest.plain_terms(F.col("title")), 1, 4)
    torn = F.transform(words, lambda w: F.when(F.length(w) > 4, F.concat(F.substring(w, 1, 2), F.substr(w, F.lit(4)))).otherwise(w))
    return catalogue(spark, folder).where(F.col("document_id") % 100 == 0).select(F.col("document_id").alias("query_id"), F.array_join(torn, " ").alias("query"))


@register(
    "correct_phrases",
    f"""
WITH RECURSIVE {CATALOGUE_SQL}, {_DROPPED},
seen AS (SELECT {_TITLE_WORDS} AS w FROM cat WHERE deleted_at IS NULL AND department_id IN {GROUPS_SQL}),
grams AS (
  SELECT unnest(w) AS g FROM seen
  UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) FROM seen
  UNION ALL SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) FROM seen),
counts AS (SELECT g, count(*) AS n FROM grams GROUP BY g),
ones AS (SELECT g AS term, n FROM counts WHERE NOT contains(g, ' ')),
total AS (SELECT sum(n) AS t FROM ones),
qw AS (SELECT query_id, query, unnest(w) AS asked, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT *, {sqltext.terms('query')} AS w FROM asked)),
near AS (
  SELECT a.asked, v.term AS word, levenshtein(a.asked, v.term) AS d, row_number() OVER (PARTITION BY a.asked ORDER BY levenshtein(a.asked, v.term), n DESC, v.term) AS r
  FROM (SELECT DISTINCT asked FROM qw) a JOIN ones v ON levenshtein(a.asked, v.term) <= CASE WHEN length(a.asked) <= 2 THEN 0 WHEN length(a.asked) <= 5 THEN 1 ELSE 2 END),
cand AS (
  SELECT asked, word, ln(CASE WHEN asked = word THEN 0.95::DOUBLE ELSE (1 - 0.95::DOUBLE) * (1 - d / (length(asked) + 1)::DOUBLE) END) AS cost, true AS known FROM near WHERE r <= 5
  UNION ALL SELECT DISTINCT asked, asked, ln(0.95::DOUBLE), false FROM qw WHERE asked NOT IN (SELECT term FROM ones)),
lat AS (SELECT query_id, query, pos, word, cost, known FROM qw JOIN cand USING (asked)),
p AS (SELECT query_id, -1 AS pos, [] :: VARCHAR[] AS path, 0.0::DOUBLE AS score FROM (SELECT DISTINCT query_id FROM lat)
  UNION ALL
  SELECT p.query_id, l.pos, list_append(p.path, l.word), p.score + l.cost + ln(
    CASE WHEN len(p.path) >= 2 AND c3.n > 0 THEN c3.n / c12.n ELSE (CASE WHEN len(p.path) >= 2 THEN 0.4::DOUBLE ELSE 1 END) *
      (CASE WHEN len(p.path) >= 1 AND c2.n > 0 THEN c2.n / c1.n ELSE (CASE WHEN len(p.path) >= 1 THEN 0.4::DOUBLE ELSE 1 END) * coalesce(c0.n, 0.5::DOUBLE) / t END) END)
  FROM p JOIN lat l ON l.query_id = p.query_id AND l.pos = p.pos + 1 CROSS JOIN total
  LEFT JOIN counts c0 ON c0.g = l.word LEFT JOIN counts c1 ON c1.g = p.path[-1] LEFT JOIN counts c2 ON c2.g = p.path[-1] || ' ' || l.word
  LEFT JOIN counts c12 ON c12.g = p.path[-2] || ' ' || p.path[-1] LEFT JOIN counts c3 ON c3.g = p.path[-2] || ' ' || p.path[-1] || ' ' || l.word),
ends AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS r FROM p JOIN (SELECT query_id, max(pos) AS pos FROM qw GROUP BY 1) USING (query_id, pos))
SELECT ends.query_id, array_to_string(path, ' ') AS suggestion FROM ends JOIN (SELECT query_id, any_value(query) AS query, bool_or(known) AS known FROM lat GROUP BY 1) k USING (query_id)
WHERE r = 1 AND known AND array_to_string(path, ' ') <> lower(query)
""",
)
def correct_phrases(spark, folder):
    """Phrases of torn title words, put right by the words around them."""
    return phrases.correct(_titles(spark, folder), _dropped_letters(spark, folder), GROUPS)
