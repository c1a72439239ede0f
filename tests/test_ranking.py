import math
import random
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.operators.access import Filters, search_filter
from docloom.operators.topk import batch_topk, cosine_queries
from docloom.settings import DEFAULTS

INDEX = (
    "chunk_id string, document_id long, level int, allowed_groups array<string>, department_id string, doctype string, tags array<string>, "
    "title string, text string, effective_date string, heading_path array<string>, page_from int, superseded boolean, embedding array<double>"
)


def index(spark, rows):
    made = [
        (f"c{i}", d, level, [dept], dept, doctype, [], title, text, date, [], 1, False, [1.0, float(i)])
        for i, (d, level, dept, doctype, title, text, date) in enumerate(rows)
    ]
    return retrieval.analyze_index(spark.createDataFrame(made, INDEX))


def catalogue(spark, rows):
    return spark.createDataFrame(
        rows, "document_id long, title string, doctype string, department_id string, effective_date string, superseded_by long, root_summary string, deleted_at timestamp"
    )


def ranking(spark, ids):
    return spark.createDataFrame([(0, x, i) for i, x in enumerate(ids, 1)], "query_id int, id string, rank int")


def test_fusion_order(spark):
    fused = retrieval.fuse([ranking(spark, "abc"), ranking(spark, "bca")])
    rows = fused.orderBy("position").collect()
    assert [r["id"] for r in rows] == ["b", "a", "c"]
    assert math.isclose(rows[0]["score"], 1 / 62 + 1 / 61)


def test_fusion_counts_an_id_once_per_list(spark):
    repeated = spark.createDataFrame([(0, "a", 1), (0, "a", 2), (0, "b", 3)], "query_id int, id string, rank int")
    scores = {r["id"]: r["score"] for r in retrieval.fuse([repeated]).collect()}
    assert math.isclose(scores["a"], 1 / 61) and math.isclose(scores["b"], 1 / 63)


def test_superseded_documents_lose_score(spark):
    candidates = spark.createDataFrame([(0, 1, 1, 2 / 61), (0, 2, 2, 1 / 62)], "query_id int, document_id long, position int, score double")
    docs = catalogue(spark, [(1, "t", "sop", "hr", None, 2, None, None), (2, "u", "sop", "hr", None, None, None, None)])
    rows = {r["document_id"]: r["score"] for r in retrieval.hydrate(candidates, docs, ["hr"], 0.7).collect()}
    assert math.isclose(rows[1], 2 / 61 * 0.7) and math.isclose(rows[2], 1 / 62)


def test_filters(spark):
    df = index(spark, [(1, 0, "hr", "sop", "a", "x", "2024-01-01"), (2, 1, "hr", "policy", "b", "x", "bad date"), (3, 0, "fin", "sop", "c", "x", "2024-02-01")])
    ids = lambda condition: {r["document_id"] for r in df.where(condition).collect()}
    assert ids(search_filter(["hr"])) == {1, 2}
    assert ids(search_filter([])) == set()
    assert ids(search_filter(["hr", "fin"], Filters(doctype=[]))) == {1, 2, 3}
    assert ids(search_filter(["hr", "fin"], Filters(doctype=["sop"], date_from="2024-01-01", date_to="2024-01-31"))) == {1}
    assert ids(search_filter(["hr"], None, leaf_only=True)) == {1}
    assert ids(search_filter(["hr", "fin"], Filters(document_ids=[3]))) == {3}


def brute_force(vectors, queries, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(vectors) @ unit(queries).T, 6)
    return {
        (q, int(i), rank)
        for q in range(len(queries))
        for rank, i in enumerate(sorted(range(len(vectors)), key=lambda i: (-scores[i, q], i))[:k], 1)
    }


def test_vector_topk_is_exact_on_both_paths(spark):
    random.seed(3)
    vectors = np.round(np.random.default_rng(0).normal(size=(300, 8)), 1)
    queries = np.round(np.random.default_rng(1).normal(size=(11, 8)), 1)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "q int, v array<double>")
    expected = brute_force(vectors, queries, 7)
    for settings in (DEFAULTS, replace(DEFAULTS, broadcast_query_rows=4, grid_cell_rows=50)):
        made = batch_topk(corpus, asked, cosine_queries, 7, None, settings)
        assert {(r["query_id"], r["id"], r["rank"]) for r in made.collect()} == expected


def test_missing_vectors_are_skipped(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, v array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.1])], "q int, v array<double>")
    assert [r["id"] for r in batch_topk(corpus, asked, cosine_queries, 5, None).orderBy("rank").collect()] == [1, 3]


def test_bm25_paths_agree(spark, small):
    from docloom.plans.corpus import GROUPS, benchmark_queries, search_index

    analyzed = retrieval.analyze_index(search_index(spark, small))
    queries = benchmark_queries(spark, small)
    plain = retrieval.lexical_topk(analyzed, search_filter(GROUPS), queries, 10)
    blocks = retrieval.lexical_topk(analyzed, search_filter(GROUPS), queries, 10, settings=replace(DEFAULTS, broadcast_query_rows=800, grid_cell_rows=60))
    rows = lambda df: {tuple(r) for r in df.select("query_id", "id", "score", "rank").collect()}
    assert rows(plain) == rows(blocks) and len(rows(plain)) == 400


def test_search_never_leaks_and_pages(spark):
    rows = [(i, 0, "hr" if i % 2 else "fin", "sop", f"leave {i}", "annual leave rules " * (i + 1), "2024-01-01") for i in range(12)]
    df = index(spark, rows)
    docs = catalogue(spark, [(i, f"leave {i}", "sop", "hr" if i % 2 else "fin", None, None, None, None) for i in range(12)])
    tags = spark.createDataFrame([(1, "Leave"), (1, "Leave"), (3, "HR")], "document_id long, tag_name string")
    asked = spark.createDataFrame([(0, "annual leave", [1.0, 2.0]), (1, "  ", [1.0, 0.0]), (2, "zzz qqq", [1.0, 0.0])], "query_id int, query string, vector array<double>")
    found = retrieval.search(df, docs, tags, asked, ["hr"], page=2, page_size=4)
    page = [r for r in found.results.collect() if r["query_id"] == 0]
    assert {r["rank"] for r in page} == {5, 6} and all(r["department_id"] == "hr" for r in page)
    assert {r["query_id"]: r["total"] for r in found.totals.collect()} == {0: 6, 2: 6}
    facets = {(r["facet"], r["value"]): r["n"] for r in found.facets.where("query_id = 0").collect()}
    assert facets == {("doctype", "sop"): 6, ("department_id", "hr"): 6, ("tags", "Leave"): 1, ("tags", "HR"): 1}
    assert [r["query_id"] for r in found.unmatched.collect()] == [2]


def test_documents_that_share_a_chunk_are_ranked_each_once(spark):
    rows = [(1, 0, "hr", "sop", "t", "annual leave", "2024-01-01"), (2, 0, "hr", "sop", "t", "annual leave", "2024-01-01"), (3, 0, "fin", "sop", "t", "annual leave", "2024-01-01"), (1, 0, "hr", "sop", "t", "other words", "2024-01-01")]
    df = index(spark, rows).withColumn("chunk_id", F.when(F.col("text") == "annual leave", F.lit("same")).otherwise(F.lit("other")))
    asked = spark.createDataFrame([(0, "annual leave", [1.0, 0.0])], "query_id int, query string, vector array<double>")
    found = retrieval.hybrid(df, asked, ["hr"]).collect()
    assert sorted((r["chunk_id"], r["document_id"], r["highlight"]) for r in found if r["chunk_id"] == "same") == [("same", i, "<mark>annual</mark> <mark>leave</mark>") for i in (1, 2)]
    assert sorted(r["position"] for r in found) == list(range(1, len(found) + 1)) and len(found) == 3


def test_highlight(spark):
    terms = F.array(F.lit("leave"), F.lit("rules"))
    made = spark.range(1).select(
        retrieval.highlight(F.lit("Before. Leave, the rules of leaves"), terms, 20).alias("h"), retrieval.highlight(F.lit("none"), terms, 20).alias("n")
    ).first()
    assert made["h"] == "<mark>Leave</mark>, the <mark>rules</mark> of " and made["n"] is None


def test_near_words_leave_the_vocabulary_where_it_lies(spark):
    words = spark.createDataFrame([(w,) for w in ("there", "their", "then", "mint", "meant", "meant")], "term string")
    asked = spark.createDataFrame([("ther",), ("meant",)], "asked string")
    near = retrieval.fuzzy_terms(words, asked)
    assert {(r.asked, r.term, r.distance) for r in near.collect()} == {("ther", "there", 1), ("ther", "their", 1), ("ther", "then", 1), ("meant", "meant", 0)}
    assert near.count() == 4
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def _mixed(spark):
    texts = ["the red fox jumps", "会议记录 the fix", "red red bread 会议", "a fox in the box", "", "记录 of the reed", "the thee then fox"]
    made = [(f"c{i}", i, 0, ["hr"], "hr", "sop", [], t[:7], t, "2024-01-01", ["part " + t[-3:]], 1, False, [1.0, float(i)]) for i, t in enumerate(texts)]
    return spark.createDataFrame(made, INDEX), spark.createDataFrame([(0, "red fox"), (1, "会议记录"), (2, "teh foks reed"), (3, "missing")], "query_id int, query string")


def test_counts_of_asked_terms_rank_like_whole_term_lists(spark):
    rows, queries = _mixed(spark)
    analyzed = retrieval.analyze_index(rows)
    for fuzzy in (False, True):
        short = retrieval.lexical_topk(analyzed, search_filter(["hr"]), queries, 3, fuzzy)
        weights = retrieval.term_weights(analyzed, queries, fuzzy)
        corpus = analyzed.select("chunk_id", *[f"terms_{name}" for name, _ in retrieval.FIELDS])
        whole = batch_topk(corpus, weights, retrieval.bm25_queries(len(retrieval.FIELDS), DEFAULTS.bm25_k1, DEFAULTS.bm25_b), 3, 0.0)
        found = sorted(map(tuple, short.collect()))
        assert found == sorted(map(tuple, whole.collect())) and len({r[0] for r in found}) == 3


def test_lexical_search_reads_texts_once(spark):
    rows, queries = _mixed(spark)
    for fuzzy in (False, True):
        read = spark.sparkContext.accumulator(0)

        @F.udf("string")
        def counting(text):
            read.add(1)
            return text

        analyzed = retrieval.analyze_index(rows.withColumn("text", counting("text")))
        assert retrieval.lexical_topk(analyzed, search_filter(["hr"]), queries, 3, fuzzy).count()
        assert read.value == rows.count()


def test_hidden_rows_and_large_sets_give_the_same_with_near_spellings(spark):
    rows, queries = _mixed(spark)
    analyzed = retrieval.analyze_index(rows)
    visible = F.col("document_id") > 1
    plain = retrieval.lexical_topk(analyzed, visible, queries, 3, True)
    blocks = retrieval.lexical_topk(analyzed, visible, queries, 3, True, replace(DEFAULTS, broadcast_query_rows=6, grid_cell_rows=2))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, blocks.collect())) and plain.count()
