from dataclasses import replace

from docloom.operators.evaluation import containing
from docloom.settings import DEFAULTS

TEXTS = [
    (1, "one two three four five six seven eight nine ten"), (2, "bone two three four five six seven eight nine tender"), (3, "one  two three four five six seven eight nine ten"),
    (4, "nothing here"), (5, None), (6, "a b"), (7, "a one two three four five six seven eight nine"), (8, "two two\ttwo two"),
]
PASSAGES = [
    (0, "one two three four five six seven eight nine ten"), (1, "two three four"), (2, "two two"), (3, "a b"), (4, "one two three four fi"), (5, "e two three"), (6, "hing"),
    (7, " two three four "), (8, "two two\ttwo"), (9, None), (10, "two three four"),
]


def test_containing_finds_every_text_that_holds_a_passage(spark):
    documents = spark.createDataFrame(TEXTS, "document_id long, text string")
    passages = spark.createDataFrame(PASSAGES, "query_id int, passage string")
    wanted = sorted((q, d) for q, p in PASSAGES for d, t in TEXTS if p is not None and t is not None and p in t)
    for settings in (DEFAULTS, replace(DEFAULTS, broadcast_query_bytes=0)):
        assert sorted((r["query_id"], r["document_id"]) for r in containing(documents, passages, settings).collect()) == wanted


def test_planted_passages_may_start_inside_a_word(spark, tmp_path):
    from docloom.plans.search_queries import planted

    text = "title\nbone two three four five six seven eight nine ten"
    spark.createDataFrame([(1, text, "src1", "en")], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, text[7:])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in planted(spark, str(tmp_path)).collect()] == [(7, 1, "short")]
