import json

from pyspark.sql import functions as F

from docloom.functions.citations import map_citations
from docloom.functions.metadata import offline_enrichment
from docloom.operators import answer, conversation, enrich, folders, retrieval, suggest
from docloom.operators.access import Filters, User
from docloom.operators.evaluation import hit_rates, hits
from docloom.settings import Settings
from docloom.functions.vectors import hash_embedder

SETTINGS = Settings(embed_dim=64)


def library(spark):
    rows = [
        (1, "hr", "Leave Policy", "policy", "Annual leave is twenty days. Carry over five days.", 2, None),
        (2, "hr", "Leave Policy 2026", "policy", "Annual leave is twenty five days in 2026.", None, "HR/1"),
        (3, "fin", "Claims", "sop", "Annual claims close in December.", None, None),
    ]
    docs = spark.createDataFrame(rows, "document_id long, department_id string, title string, doctype string, text string, superseded_by long, supersedes_ref string")
    docs = docs.withColumns(
        {"deleted_at": F.lit(None).cast("timestamp"), "effective_date": F.lit("2026-01-01"), "root_summary": F.when(F.col("document_id") == 2, "All about leave."),
         "status": F.lit("READY"), "reference_no": F.when(F.col("document_id") == 1, "hr/1"), "created_at": F.lit("2026-01-01").cast("timestamp"), "updated_at": F.lit("2026-01-01").cast("timestamp")}
    )
    index = docs.select(
        F.concat(F.lit("c"), F.col("document_id").cast("string")).alias("chunk_id"), "document_id", F.lit(0).alias("level"), F.array("department_id").alias("allowed_groups"),
        "department_id", "doctype", "title", "text", "effective_date", F.array(F.lit("Scope")).alias("heading_path"), F.lit(3).alias("page_from"),
        F.col("superseded_by").isNotNull().alias("superseded"), hash_embedder(64)("text").alias("embedding"),
    )
    tags = spark.createDataFrame([(2, "Leave"), (1, "Leave"), (3, "Money")], "document_id long, tag_name string")
    return retrieval.analyze_index(index), docs, tags


def test_events_prompt_and_citations(spark):
    index, docs, _ = library(spark)
    seen = {}

    def model(instructions, prompt):
        seen["prompt"] = prompt
        yield from ["Twenty five days ", "[1]", "", " and [9]."]

    events = list(answer.answer_events(index, docs, "annual leave days", ["hr"], model, settings=SETTINGS))
    assert [e for e, _ in events] == ["token", "token", "token", "citations", "done"]
    cited = events[-2][1]["citations"]
    assert len(cited) == 1 and cited[0]["n"] == 1 and cited[0]["page"] == 3
    assert "SUPERSEDED" in seen["prompt"] and "Claims" not in seen["prompt"] and "page 3 | Scope" in seen["prompt"]
    silent = list(answer.answer_events(index, docs, "annual leave days", ["hr"], lambda i, p: ["no marks"], settings=SETTINGS))
    assert [c["n"] for c in silent[-2][1]["citations"]] == [1, 2]


def test_nothing_found_and_errors(spark):
    index, docs, _ = library(spark)
    nothing = list(answer.answer_events(index, docs, "leave", ["nobody"], lambda i, p: ["x"], settings=SETTINGS))
    assert nothing == [("token", {"text": answer.NOTHING_FOUND}), ("citations", {"citations": []}), ("done", {})]

    def broken(instructions, prompt):
        raise RuntimeError("model down")

    assert list(answer.answer_events(index, docs, "leave", ["hr"], broken, settings=SETTINGS)) == [("error", {"message": "model down"})]


def test_tools(spark):
    index, docs, tags = library(spark)
    tools = answer.Toolbox(index, docs, tags, User("u", {"hr": "viewer"}), max_calls=5, settings=SETTINGS)
    text = tools.search_documents("annual leave")
    assert text.count("document_id=") == 2 and "SUPERSEDED by 'Leave Policy 2026' (2)" in text and "[1]" in text
    assert tools.search_documents("annual leave").count("[1]") == 1 and len(tools.sources) == 2
    card = json.loads(tools.get_document(2))
    assert card["tags"] == ["Leave"] and card["supersedes"]["title"] == "Leave Policy" and card["summary_source"].startswith("[3] ")
    assert tools.get_document(3) == answer.NOT_FOUND
    listed = json.loads(tools.list_documents(tag="leave", department_id="fin"))
    assert listed["total"] == 2
    assert tools.list_documents() == answer.TOOL_LIMIT_REACHED
    assert [c["n"] for c in tools.citations([3, 1, 1, 44])] == [1, 3]
    scoped = answer.Toolbox(index, docs, tags, User("u", {"hr": "viewer"}), Filters(doctype=["sop"]), settings=SETTINGS)
    assert scoped.search_documents("leave", doctype="policy") == "No matching passages found within the selected documents."


def test_latest_changes(spark):
    versions = spark.createDataFrame(
        [(1, 1, ["a", "b"], None, None), (1, 2, ["a", "c"], 1, ["a", "b"])],
        "document_id long, version_no int, chunk_manifest array<string>, prev_version_no int, prev_chunk_manifest array<string>",
    )
    chunks = spark.createDataFrame([(1, x, f"text {x}", ["S"]) for x in "abc"], "document_id long, chunk_id string, text string, heading_path array<string>")
    made = {r["change"]: r["passage"] for r in answer.latest_changes(versions, chunks).collect()}
    assert made == {"added": "added in v2 | section=S\ntext c", "removed": "removed in v2 | section=S\ntext b"}


def test_history(spark):
    turns = [("assistant", "hello"), ("user", "a"), ("user", "b"), ("assistant", " "), ("assistant", "c"), ("user", "d")]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    assert [(r["role"], r["text"]) for r in conversation.history(df).orderBy("position").collect()] == [("user", "a\n\nb"), ("assistant", "c")]


def test_suggestions(spark):
    titles = spark.createDataFrame(
        [(1, "Leave Policy", ["Leave", "HR"], "hr"), (2, "Annual leave form", ["Leave"], "hr"), (3, "Benefits", ["HR"], "hr"), (4, "Leave secret", ["Secret"], "fin")],
        "document_id long, title string, tags array<string>, department_id string",
    ).withColumns({"doctype": F.lit("sop"), "allowed_groups": F.array("department_id")})
    index = suggest.title_index(titles)
    found = lambda text: [r["document_id"] for r in suggest.suggest_documents(index, text, ["hr"]).collect()]
    assert found("leave") == [1, 2] and found("lea") == [1, 2] and found("l") == [] and found("Leave Policy")[0] == 1
    assert found("benifits") == [3]
    tags = spark.createDataFrame([(1, "Leave"), (2, "HR"), (3, "Parental leave")], "tag_id long, name string")
    assert [r["name"] for r in suggest.suggest_tags(index, tags, "leave", ["hr"]).collect()] == ["Leave", "Parental leave", "HR"]
    asked = spark.createDataFrame([(0, "anual leeve"), (1, "leave"), (2, "xyzxyz")], "query_id int, query string")
    assert {r["query_id"]: r["suggestion"] for r in suggest.did_you_mean(index, asked, ["hr"]).collect()} == {0: "annual leave"}


def test_evaluation(spark):
    results = spark.createDataFrame([(0, 5, 1), (1, 6, 6), (2, 7, 2)], "query_id int, document_id long, rank int")
    expected = spark.createDataFrame([(0, 5, "exact"), (1, 6, "exact"), (2, 7, "typo"), (3, 1, "typo")], "query_id int, document_id long, category string")
    rates = {r["category"]: (r["hits"], r["total"], r["passed"]) for r in hit_rates(hits(results, expected)).collect()}
    assert rates == {"exact": (1, 2, False), "typo": (1, 2, False), "overall": (2, 4, False)}


def test_enrichment_end_to_end(spark):
    block = "array<struct<order:int,type:string,text:string,page:int,level:int,font_size:double>>"
    rows = [
        (1, "hr", "Untitled document", "default", 0.0, "inbox", "circular_7.docx", None, [], "Circular KPT/HR/7\nEffective 2024-05-01 replaces KPT/HR/6"),
        (2, "hr", "Mine", "user", 1.0, "kept", "x.docx", None, [(0, "heading", "Other Title", 1, 1, None)], "some text"),
    ]
    df = spark.createDataFrame(rows, f"document_id long, department_id string, title string, title_source string, title_confidence double, folder_id string, filename string, embedded_title string, blocks {block}, sample string")
    tree = spark.createDataFrame(folders.DEFAULT_FOLDERS, "folder_id string, name string, parent_id string")
    made = {r["document_id"]: r for r in enrich.enrich(df, tree, offline_enrichment).collect()}
    first, second = made[1], made[2]
    assert (first["doctype"], first["folder_id"], first["reference_no"], first["supersedes_ref"], first["effective_date"]) == ("circular", "circ-2024", "KPT/HR/7", "KPT/HR/6", "2024-05-01")
    assert (first["title"], first["title_source"], first["title_confidence"]) == ("Circular KPT/HR/7", "llm", 0.7)
    assert (second["title"], second["folder_id"], second["doctype"]) == ("Mine", "kept", "other")


def test_tag_suggestions_never_overwrite(spark):
    vectors = spark.createDataFrame([(1, "hr", [1.0, 0.0]), (2, "fin", [0.0, 1.0])], "document_id long, department_id string, vector array<double>")
    tags = spark.createDataFrame([(1, "A", "hr", [1.0, 0.1]), (2, "B", None, [1.0, 1.0]), (3, "C", "fin", [1.0, 0.0]), (4, "D", None, None)], "tag_id long, name string, department_id string, centroid array<double>")
    close = enrich.centroid_suggestions(vectors, tags)
    assert {(r["document_id"], r["tag_id"]) for r in close.collect()} == {(1, 1), (1, 2), (2, 2)}
    named = enrich.named_tags(spark.createDataFrame([(1, "hr", [" d ", "a", "zzz", "c"])], "document_id long, department_id string, names array<string>"), tags)
    assert {(r["document_id"], r["tag_id"]) for r in named.collect()} == {(1, 4), (1, 1)}
    existing = spark.createDataFrame([(1, 1)], "document_id long, tag_id long")
    assert {(r["document_id"], r["tag_id"], r["similarity"] is None) for r in enrich.new_tag_links(close, named, existing).collect()} == {(1, 2, False), (1, 4, True), (2, 2, False)}


def test_centroids_skip_odd_sizes_and_zero_means(spark):
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (2, 5)], "tag_id long, document_id long")
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0]), (3, None), (4, [1.0]), (5, [-1.0])], "document_id long, vector array<double>")
    assert {r["tag_id"]: [round(x, 6) for x in r["centroid"]] for r in enrich.tag_centroids(links, vectors).collect()} == {1: [0.6, 0.8]}


def test_citation_titles(spark):
    h = spark.createDataFrame([(0, 1, 1, "c", "", 1, "x" * 400, 1)], "query_id int, rank int, document_id long, chunk_id string, title string, page_from int, text string, position int")
    made = map_citations(spark.createDataFrame([(0, "[1]")], "query_id int, answer string"), h).first()
    assert made["title"] == "Untitled document" and len(made["quote"]) == 300
