"""Hybrid retrieval: exact vector top-k and BM25 top-k, fused, guarded, re-ranked and faceted."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.skew import top_per_key
from docloom.functions.text import HAN, auto_distance, cjk_terms, collapse, normalize, probe_keys, segment_keys, standard_terms, within_edits
from docloom.functions.vectors import hash_embedder, mean_vectors
from docloom.operators.access import Filters, readable, search_filter
from docloom.operators.topk import _collect_bounded, batch_topk, bm25_cells, bm25_queries, cosine_queries, count_cells
from docloom.session import cut_lineage
from docloom.settings import DEFAULTS, Settings

# Searched fields with their boosts. A row scores its best field.
FIELDS = (("title", 3.0), ("text", 1.0), ("cjk", 1.0), ("heading", 2.0))
SMALL_QUERY_SET = 2_000
SMALL_KEYS = 100_000  # keys of searched words that may go to every task


def is_small(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def analyze_index(index: DataFrame) -> DataFrame:
    """Add the term arrays of every searched field.

    Without an ideograph both readings of a text give the same terms, which are then made once.
    """
    analyzed = index.withColumns(
        {
            "terms_title": standard_terms(F.coalesce("title", F.lit(""))),
            "terms_text": standard_terms(F.col("text")),
            "terms_heading": standard_terms(F.array_join("heading_path", " ")),
        }
    )
    analyzed = analyzed.withColumn("terms_cjk", F.when(F.col("text").rlike(HAN), cjk_terms(F.col("text"))).otherwise(F.col("terms_text")))
    return analyzed.select(*index.columns, *[f"terms_{name}" for name, _ in FIELDS])


def field_statistics(analyzed: DataFrame) -> DataFrame:
    """``(field, n_docs, avg_len)``: one row per searched field."""
    parts = [F.struct(F.lit(i).alias("field"), F.size(f"terms_{name}").alias("length")) for i, (name, _) in enumerate(FIELDS)]
    lengths = analyzed.select(F.explode(F.array(*parts)).alias("p")).select("p.field", "p.length").where("length > 0")
    return lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_len"))


def _fielded(terms: Column, field: int) -> Column:
    return F.transform(terms, lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))


def vocabulary(analyzed: DataFrame) -> DataFrame:
    """``(field, term, df)``; counts are combined inside each task before the shuffle."""
    parts = [_fielded(F.array_distinct(f"terms_{name}"), i) for i, (name, _) in enumerate(FIELDS)]
    terms = analyzed.select(F.explode(F.concat(*parts)).alias("p")).select("p.field", "p.term")
    return terms.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, field, term, qtf)`` for every searched field."""
    standard, cjk = standard_terms(F.col("query")), cjk_terms(F.col("query"))
    parts = [_fielded(cjk if name == "cjk" else standard, i) for i, (name, _) in enumerate(FIELDS)]
    exploded = queries.select("query_id", F.explode(F.concat(*parts)).alias("p")).select("query_id", "p.field", "p.term")
    return exploded.groupBy("query_id", "field", "term").agg(F.count(F.lit(1)).alias("qtf"))


def fuzzy_terms(words: DataFrame, asked: DataFrame) -> DataFrame:
    """``(asked, term, distance)``: every vocabulary word within the automatic edit distance.

    Both sides have one string column. Matches meet on a shared piece of the word (an equi-join), then
    the true distance decides. A vocabulary is passed over where it lies while the searched words' keys are few, else both sides are
    dealt by key.
    """
    left = asked.toDF("asked").distinct()
    right = words.toDF("term")
    left_keys = cut_lineage(
        left.withColumn("limit", auto_distance(F.col("asked"))).select("asked", "limit", F.explode(probe_keys(F.col("asked"), F.col("limit"))).alias("key"))
    )
    if is_small(left_keys, SMALL_KEYS):
        left_keys = F.broadcast(left_keys)  # checked: at most SMALL_KEYS pieces of words
    else:
        right = right.distinct()
    right_keys = right.select("term", F.explode(segment_keys(F.col("term"))).alias("key"))
    matched = left_keys.join(right_keys, "key").where(within_edits(F.col("asked"), F.col("term"), F.col("limit")))
    return matched.select("asked", "term", F.levenshtein("asked", "term").alias("distance")).distinct()


def term_weights(analyzed: DataFrame, queries: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Weighted query terms: boost x query frequency x ln(1 + (N - df + 0.5) / (df + 0.5)).

    With ``fuzzy`` every near spelling counts too, scaled by ``1 - edits / shorter length``.
    """
    asked = query_terms(queries)
    return _all_weights(analyzed, near_terms(asked, distinct_words(analyzed)) if fuzzy else asked)


def _all_weights(analyzed: DataFrame, asked: DataFrame) -> DataFrame:
    """Weights of ``asked`` by the counts of the whole vocabulary."""
    return _weighted(asked.join(vocabulary(analyzed), ["field", "term"]), field_statistics(analyzed)).select("query_id", "field", "term", "weight", "avg_len")


def near_terms(asked: DataFrame, words: DataFrame) -> DataFrame:
    """``asked`` with every near spelling among ``words`` in place of its terms."""
    near = fuzzy_terms(words, asked.select("term"))
    closeness = 1 - F.col("distance") / F.least(F.length("asked"), F.length("term"))
    widened = asked.withColumnRenamed("term", "asked").join(near, "asked").withColumn("qtf", F.col("qtf") * closeness)
    return widened.groupBy("query_id", "field", "term").agg(F.sum("qtf").alias("qtf"))


def _weighted(found: DataFrame, statistics: DataFrame) -> DataFrame:
    """Add ``weight`` and ``avg_len`` to ``(field, qtf, df)``."""
    boosts = F.element_at(F.array(*[F.lit(boost) for _, boost in FIELDS]), F.col("field") + 1)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # One row per field, never more.
    return found.join(F.broadcast(statistics), "field").withColumn("weight", boosts * F.col("qtf") * idf)


def distinct_words(analyzed: DataFrame) -> DataFrame:
    """The words of all fields, once each."""
    same = F.col("terms_cjk") == F.col("terms_text")
    fields = [F.when(same, F.array().cast("array<string>")).otherwise(F.col("terms_cjk")) if name == "cjk" else F.col(f"terms_{name}") for name, _ in FIELDS]
    return analyzed.select(F.explode(F.array_distinct(F.concat(*fields))).alias("term")).distinct()


def lexical_topk(
    analyzed: DataFrame, visible: Column, queries: DataFrame, k: int, fuzzy: bool = False, settings: Settings = DEFAULTS, key: str | Column = "chunk_id"
) -> DataFrame:
    """BM25 over all fields; statistics cover the whole index, results only its visible rows. ``key`` names the rows.

    While the asked terms may be sent to every task, texts are cut into terms once: what a row holds of the asked terms is
    written as small counts, from which document frequencies, lengths and scores are read.
    """
    asked = query_terms(queries)
    if fuzzy:
        analyzed = cut_lineage(analyzed.select(key if isinstance(key, Column) else F.col(key), visible.alias("_visible"), *[f"terms_{name}" for name, _ in FIELDS]))
        asked = cut_lineage(near_terms(asked, distinct_words(analyzed)))
        key, visible = analyzed.columns[0], F.col("_visible")
    shipped = _collect_bounded(asked, settings)
    if shipped is None:
        corpus = analyzed.where(visible).select(key, *[f"terms_{name}" for name, _ in FIELDS])
        return batch_topk(corpus, _all_weights(analyzed, asked), bm25_queries(len(FIELDS), settings.bm25_k1, settings.bm25_b), k, 0.0, settings)

    rows = analyzed.select(key if isinstance(key, Column) else F.col(key), F.coalesce(visible, F.lit(False)).alias("_visible"), *[f"terms_{name}" for name, _ in FIELDS])
    terms = sorted(set(shipped.column("term").to_pylist()))
    counted = cut_lineage(count_cells(rows, terms, len(FIELDS)))
    frequencies = counted.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("df"))
    parts = [F.struct(F.lit(i).alias("field"), F.col("lengths")[i].alias("length")) for i in range(len(FIELDS))]
    lengths = counted.select(F.explode(F.array(*parts)).alias("p")).select("p.field", "p.length").where("length > 0")
    statistics = lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_len"))
    numbered = asked.sparkSession.createDataFrame(list(enumerate(terms)), "slot int, term string")
    cells = asked.join(numbered, "term").withColumn("cell", F.col("field") * len(terms) + F.col("slot"))
    weights = _weighted(cells.join(frequencies, "cell"), statistics).select("query_id", "field", "cell", "weight", "avg_len")
    corpus = counted.where("_visible AND size(cells) > 0").drop("_visible")
    return batch_topk(corpus, weights, bm25_cells(len(FIELDS), len(terms), settings.bm25_k1, settings.bm25_b), k, 0.0, settings)


def vector_topk(index: DataFrame, visible: Column, queries: DataFrame, k: int, settings: Settings = DEFAULTS, key: str | Column = "chunk_id") -> DataFrame:
    """Exact cosine search after filtering: ``queries`` is ``(query_id, vector)``. ``key`` names the rows."""
    corpus = index.where(visible).select(key, "embedding")
    return batch_topk(corpus, queries, cosine_queries, k, None, settings)


def fuse(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``(query_id, id, rank)`` lists, earlier lists winning ties."""
    lists = [r.select("query_id", "id", "rank", F.lit(i).alias("list")) for i, r in enumerate(rankings)]
    merged = lists[0]
    for other in lists[1:]:
        merged = merged.unionByName(other)
    once = merged.groupBy("query_id", "id", "list").agg(F.min("rank").alias("rank"))
    seen = F.min(F.struct("list", "rank")).alias("seen")
    scored = once.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), seen)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col("seen"), F.col("id"))
    return scored.withColumn("position", F.row_number().over(order)).select("query_id", "id", "score", "position")


def highlight(text: Column, terms: Column, chars: int) -> Column:
    """The ``chars`` characters from the first matching word on, matching words marked; null without a match."""
    edge = r"[\p{L}\p{N}]"
    word = F.concat(F.lit(f"(?<!{edge})("), F.array_join(terms, "|"), F.lit(f")(?!{edge})"))
    found = F.call_function("regexp_extract", text, F.concat(F.lit("(?siu)"), word, F.lit(f".{{0,{chars}}}")), F.lit(0))
    marked = F.regexp_replace(F.substring(found, 1, chars), F.concat(F.lit("(?iu)"), word), F.lit("<mark>$1</mark>"))
    return F.when((F.size(terms) > 0) & (found != ""), marked)


def snippet(highlighted: Column, text: Column, chars: int = DEFAULTS.snippet_chars) -> Column:
    return F.coalesce(highlighted, F.substring(text, 1, chars))


def row_key(index: DataFrame) -> Column:
    """Names an index row: documents may share a chunk (its id comes from its content). Sorts like (chunk_id, document_id)."""

    def sortable(name: str) -> Column:
        if index.schema[name].dataType.simpleString() == "string":
            return F.col(name)
        return F.lpad((F.col(name).cast("decimal(20,0)") + F.lit(1 << 62).cast("decimal(20,0)") * 2).cast("string"), 20, "0")

    return F.concat(sortable("chunk_id"), F.lit("\u0000"), sortable("document_id"))


def hybrid(
    analyzed: DataFrame,
    queries: DataFrame,
    groups: list[str],
    filters: Filters | None = None,
    leaf_only: bool = True,
    fuzzy: bool = False,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Fused candidates with their index columns; ``queries`` is ``(query_id, query, vector)``.

    A chunk that several documents share is ranked once for each of them.
    """
    visible = search_filter(groups, filters, leaf_only)
    key = row_key(analyzed).alias("_row")
    nearest = vector_topk(analyzed, visible, queries.select("query_id", "vector"), settings.knn_k, settings, key)
    lexical = lexical_topk(analyzed, visible, queries.select("query_id", "query"), settings.bm25_size, fuzzy, settings, key)
    fused = fuse([nearest, lexical], settings.rrf_k).withColumnRenamed("id", "_row")
    matched = lexical.select("query_id", F.col("id").alias("_row"), F.lit(True).alias("_lexical"))
    terms = queries.select("query_id", F.array_distinct(standard_terms(F.col("query"))).alias("_terms"))
    candidates = fused.join(matched, ["query_id", "_row"], "left").join(terms, "query_id")
    if is_small(queries, SMALL_QUERY_SET):
        # Checked: at most SMALL_QUERY_SET x (knn_k + bm25_size) short rows.
        candidates = F.broadcast(candidates)
    source = analyzed.where(visible).select(key, "chunk_id", "document_id", "level", "text", "heading_path", "page_from")
    marked = F.when(F.col("_lexical"), highlight(F.col("text"), F.col("_terms"), settings.highlight_chars))
    return source.join(candidates, "_row").withColumn("highlight", marked).drop("_row", "_terms", "_lexical")


def best_per_document(candidates: DataFrame) -> DataFrame:
    return top_per_key(candidates, ["query_id", "document_id"], [F.col("position")], 1, "_best").drop("_best")


def hydrate(candidates: DataFrame, documents: DataFrame, groups: list[str], penalty: float) -> DataFrame:
    """Re-check access against the catalogue and lower the score of replaced documents."""
    rows = readable(documents, groups).select(
        "document_id", F.col("title"), "doctype", "department_id", "effective_date", "superseded_by", "root_summary"
    )
    joined = candidates.join(rows, "document_id")
    return joined.withColumn("score", F.when(F.col("superseded_by").isNotNull(), F.col("score") * penalty).otherwise(F.col("score")))


def ranked(results: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col("position"))
    return results.withColumn("rank", F.row_number().over(order))


@dataclass(frozen=True)
class SearchResponse:
    """All parts of one answer, still lazy."""

    results: DataFrame
    facets: DataFrame
    totals: DataFrame
    unmatched: DataFrame


def search(
    analyzed: DataFrame,
    documents: DataFrame,
    document_tags: DataFrame,
    queries: DataFrame,
    groups: list[str],
    filters: Filters | None = None,
    page: int = 1,
    page_size: int = 10,
    fuzzy: bool = False,
    settings: Settings = DEFAULTS,
) -> SearchResponse:
    """One result per document, paged, with facets over everything found.

    ``unmatched`` lists the queries without any highlighted result: those are worth a spelling suggestion.
    Blank queries find nothing.
    """
    asked = queries.where(F.trim("query") != "")
    # At most knn_k + bm25_size rows per query; written once because four outputs read them.
    best = cut_lineage(best_per_document(hybrid(analyzed, asked, groups, filters, True, fuzzy, settings)))
    found = ranked(hydrate(best, documents, groups, settings.superseded_penalty))
    found = found.withColumn("snippet", snippet(F.col("highlight"), F.col("text"), settings.snippet_chars))
    tagged = with_tags(found, document_tags)
    page, page_size = max(page, 1), max(page_size, 1)
    shown = tagged.where(F.col("rank").between((page - 1) * page_size + 1, page * page_size))
    totals = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    lexical = best.groupBy("query_id").agg(F.max(F.col("highlight").isNotNull()).alias("_any"))
    unmatched = asked.join(lexical.where("_any"), "query_id", "left_anti").select("query_id", "query")
    return SearchResponse(shown, facets(tagged), totals, unmatched)


def retrieve(
    analyzed: DataFrame,
    documents: DataFrame,
    queries: DataFrame,
    groups: list[str],
    k: int | None = None,
    filters: Filters | None = None,
    fuzzy: bool = False,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Passages for answering: summaries included, several passages of one document allowed."""
    candidates = hybrid(analyzed, queries.where(F.trim("query") != ""), groups, filters, False, fuzzy, settings)
    hits = ranked(hydrate(candidates, documents, groups, settings.superseded_penalty))
    return hits.where(F.col("rank") <= (k or settings.ask_top_k))


def with_tags(results: DataFrame, document_tags: DataFrame) -> DataFrame:
    """Attach each document's distinct tag names; ``results`` is a bounded page of candidates."""
    wanted = results.select("document_id").distinct()
    names = (
        document_tags.join(wanted, "document_id", "left_semi")
        .groupBy("document_id")
        .agg(F.array_sort(F.collect_set("tag_name")).alias("tags"))
    )
    return results.join(names, "document_id", "left").withColumn(
        "tags", F.coalesce("tags", F.array().cast("array<string>"))
    )


def facets(results: DataFrame) -> DataFrame:
    """``(query_id, facet, value, n)`` over every readable result, each document counted once per value."""
    pairs = F.concat(
        F.array(
            F.struct(F.lit("doctype").alias("facet"), F.col("doctype").alias("value")),
            F.struct(F.lit("department_id").alias("facet"), F.col("department_id").alias("value")),
        ),
        F.transform(F.array_distinct("tags"), lambda t: F.struct(F.lit("tags").alias("facet"), t.alias("value"))),
    )
    rows = results.select("query_id", F.explode(pairs).alias("p")).select("query_id", "p.facet", "p.value")
    counted = rows.where(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("query_id", "facet", "value")
    order = Window.partitionBy("query_id", "facet").orderBy(F.col("n").desc(), F.col("value"))
    return counted.agg(F.count(F.lit(1)).alias("n")).withColumn("position", F.row_number().over(order))


def embed_queries(queries: DataFrame, dim: int = DEFAULTS.embed_dim) -> DataFrame:
    """``(query_id, query, vector)`` with the query normalised before embedding."""
    return queries.withColumn("vector", hash_embedder(dim)(normalize(F.col("query"))))


@lru_cache(maxsize=256)
def embed_query(text: str, dim: int = DEFAULTS.embed_dim) -> tuple[float, ...]:
    """Driver-side embedding of one typed query, remembered for repeats."""
    from docloom.functions.vectors import embed_texts

    return tuple(embed_texts([" ".join(text.split()).lower()], dim)[0].tolist())


def one_query(spark, text: str, dim: int = DEFAULTS.embed_dim) -> DataFrame:
    """A single interactive query in the shape the batch operators take."""
    vector = list(embed_query(" ".join(text.split()).lower(), dim))
    return spark.createDataFrame([(0, text, vector)], "query_id int, query string, vector array<double>")


def document_vectors(chunks: DataFrame, current: DataFrame) -> DataFrame:
    """``(document_id, vector)``: the mean over the chunks of the current manifest, over all chunks where none of those has a vector.

    ``chunks`` is ``(document_id, chunk_id, embedding)``, ``current`` the ``(document_id, chunk_id)`` of the manifests.
    """
    known = chunks.where(F.col("embedding").isNotNull()).select("document_id", "chunk_id", "embedding")
    listed = known.join(current.select("document_id", "chunk_id").distinct(), ["document_id", "chunk_id"], "left_semi")
    inside = mean_vectors(listed, ["document_id"], "embedding").select("document_id", F.col("mean_vector").alias("_inside"))
    return mean_vectors(known, ["document_id"], "embedding").join(inside, "document_id", "left").select("document_id", F.coalesce("_inside", "mean_vector").alias("vector"))


def fill_embeddings(rows: DataFrame, text: str = "text", dim: int = DEFAULTS.embed_dim) -> DataFrame:
    """Embed only rows whose vector is missing, keeping the others untouched; flags what was computed."""
    flagged = rows.withColumn("reembedded", F.col("embedding").isNull())
    missing = F.when(F.col("reembedded"), F.col(text))
    return flagged.withColumn("embedding", F.coalesce("embedding", hash_embedder(dim)(missing)))


__all__ = [
    "analyze_index", "best_per_document", "collapse", "document_vectors", "embed_queries", "facets", "fill_embeddings", "fuse", "fuzzy_terms",
    "highlight", "hybrid", "lexical_topk", "one_query", "retrieve", "search", "snippet", "term_weights", "vector_topk",
    "vocabulary",
]
