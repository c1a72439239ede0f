import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.operators import access, catalog, enrich, folders, jobs, versioning
from docloom.sources import index_store

NOW = dt.datetime(2026, 1, 1)


def documents(spark, rows):
    schema = "document_id long, title string, department_id string, status string, created_at timestamp, updated_at timestamp, deleted_at timestamp, folder_id string"
    return spark.createDataFrame(rows, schema)


def row(i, title, dept="hr", status="READY", deleted=None, folder="inbox"):
    return (i, title, dept, status, NOW + dt.timedelta(days=i), NOW, deleted, folder)


def test_listing_orders_and_pages(spark):
    df = documents(spark, [row(1, "Charlie"), row(2, "alpha"), row(3, "Bravo"), row(4, "gone", deleted=NOW), row(5, "other", dept="fin")])
    rows = catalog.listing(df, None, ["hr"])
    titles = lambda sort, page=1, size=20: [r["title"] for r in catalog.page_of(rows, sort, page, size).collect()]
    assert titles("title") == ["alpha", "Bravo", "Charlie"] and titles("-title") == ["Charlie", "Bravo", "alpha"]
    assert titles("nonsense") == ["Bravo", "alpha", "Charlie"]
    assert titles("created_at", 2, 2) == ["Bravo"] and titles("title", 0, 0) == ["alpha"]


def test_changes(spark):
    df = documents(spark, [row(1, "a"), row(2, "b", deleted=NOW)])
    later = F.lit("2026-02-02").cast("timestamp")
    changed = catalog.update_fields(df, spark.createDataFrame([(1, "new")], "document_id long, title string"), ["title"], later)
    assert {r["document_id"]: (r["title"], r["updated_at"].month) for r in changed.collect()} == {1: ("new", 2), 2: ("b", 1)}
    with pytest.raises(ValueError):
        catalog.update_fields(df, df, ["department_id"], later)
    gone = catalog.soft_delete(df, spark.createDataFrame([(1,), (2,)], "document_id long"), later)
    assert {r["document_id"]: r["deleted_at"].month for r in gone.collect()} == {1: 2, 2: 1}


def test_tags_are_found_without_case_and_created_once(spark):
    tags = spark.createDataFrame([(4, "Leave", "hr"), (5, "Global", None)], "tag_id long, name string, department_id string")
    wanted = spark.createDataFrame([(" LEAVE ", "hr"), ("leave", "fin"), ("global", None), ("New  Tag", None), ("new tag", None), (" ", "hr")], "name string, department_id string")
    made = catalog.get_or_create_tags(tags, wanted).collect()
    assert sorted((r["name"].lower(), r["department_id"] or "") for r in made) == [("global", ""), ("leave", "fin"), ("leave", "hr"), ("new tag", "")]
    assert len({r["tag_id"] for r in made}) == 4 and min(r["tag_id"] for r in made) == 4


def test_find_by_reference(spark):
    df = documents(spark, [row(1, "a"), row(2, "b"), row(3, "c"), row(4, "d", deleted=NOW)]).withColumn("reference_no", F.lit("Ref/1"))
    asked = spark.createDataFrame([(3, "hr", "REF/1"), (9, "hr", "ref/1"), (8, "fin", "ref/1"), (7, "hr", None)], "document_id long, department_id string, reference_no string")
    assert {r["document_id"]: r["found_id"] for r in catalog.find_by_reference(df, asked).collect()} == {3: 2, 9: 3}


def test_supersedes(spark):
    df = documents(spark, [row(1, "old"), row(2, "new"), row(3, "newer")])
    refs = spark.createDataFrame([(1, "A/1", None), (2, "A/2", "a/1"), (3, "A/3", "a/1")], "document_id long, reference_no string, supersedes_ref string")
    joined = df.join(refs, "document_id").withColumn("superseded_by", F.lit(None).cast("long"))
    assert {r["document_id"]: r["superseded_by"] for r in enrich.apply_supersedes(joined).collect()} == {1: 3, 2: None, 3: None}


def test_access(spark):
    user = access.User("u", {"hr": "viewer", "fin": "admin"})
    assert user.groups == ["fin", "hr"]
    members = spark.createDataFrame([("u", "hr", "viewer"), ("u", "fin", "admin"), ("v", "hr", "admin")], "user_id string, department_id string, role string")
    df = documents(spark, [row(1, "a"), row(2, "b", dept="fin")])
    assert [r["document_id"] for r in access.writable(df, members, "u").collect()] == [2]
    assert access.narrow_scope(access.Filters(doctype=["sop"]), "policy") == (None, False)
    assert access.narrow_scope(None, "policy")[0].doctype == ["policy"] and access.narrow_scope(None, "bogus") == (None, True)


def test_folders(spark):
    tree = spark.createDataFrame(folders.DEFAULT_FOLDERS, "folder_id string, name string, parent_id string")
    assert [r["folder_id"] for r in tree.orderBy(*folders.folder_order()).collect()][:3] == ["inbox", "circ-2024", "circ-2026"]
    assert {r["folder_id"] for r in folders.descendants(tree, "sops").collect()} == {"sop-fin", "sop-hr"}
    with pytest.raises(folders.FolderConflict):
        folders.create_folder(tree, "FINANCE", "sops")
    with pytest.raises(folders.FolderCycle):
        folders.change_folder(tree, "sops", parent_id="sop-hr", move=True)
    with pytest.raises(KeyError):
        folders.create_folder(tree, "x", "nowhere")
    moved = folders.change_folder(tree, "sop-hr", name="People", parent_id=None, move=True)
    assert moved.where("folder_id = 'sop-hr' AND name = 'People' AND parent_id IS NULL").count() == 1
    added = folders.create_folder(tree, "Ümlaut & Co")
    assert added.where("folder_id LIKE 'mlaut-co-______'").count() == 1
    df = documents(spark, [row(1, "a", folder="sop-hr"), row(2, "b", folder="inbox"), row(3, "c", folder="lost")])
    left, emptied = folders.delete_folder(tree, df, "sops", F.lit("2026-02-02").cast("timestamp"))
    assert left.count() == 9
    assert {r["document_id"]: (r["folder_id"], r["deleted_at"] is not None) for r in emptied.collect()} == {1: (None, True), 2: ("inbox", False), 3: ("lost", False)}
    assert {r["document_id"]: r["folder_id"] for r in folders.known_folder(df, tree).collect()} == {1: "sop-hr", 2: "inbox", 3: "inbox"}


def test_cyclic_folders_end(spark):
    loop = spark.createDataFrame([("a", "A", "b"), ("b", "B", "a")], "folder_id string, name string, parent_id string")
    assert {r["folder_id"] for r in folders.descendants(loop, "a").collect()} == {"b"}


def test_delta_plan(spark):
    rows = [(1, None, ["a", "b"]), (2, ["a", "b"], ["a", "b"]), (3, ["a", "b", "c", "b"], ["c", "x", "x", "a"])]
    made = {r["k"]: r for r in versioning.plan_delta(spark.createDataFrame(rows, "k int, old_manifest array<string>, new_manifest array<string>")).collect()}
    assert made[1]["added"] == ["a", "b"] and not made[1]["unchanged"] and made[1]["old_root"] is None
    assert made[2]["unchanged"] and made[2]["reused"] == ["a", "b"] and made[2]["added"] == []
    assert (made[3]["added"], made[3]["removed"], made[3]["reused"]) == (["x", "x"], ["b", "b"], ["c", "a"])


def test_job_retries(spark):
    now = F.lit("2026-01-01").cast("timestamp")
    schema = "job_id long, document_id long, version_id long, stage string, status string, attempts int, run_after timestamp, last_error string"
    queue = spark.createDataFrame([(2, 1, 1, "index", "queued", 0, NOW, None), (1, 1, 1, "extract", "queued", 2, NOW, None), (3, 1, 1, "enrich", "queued", 0, NOW + dt.timedelta(1), None)], schema)
    running = jobs.claim(queue, now, 5)
    assert [(r["job_id"], r["attempts"], r["status"]) for r in running.collect()] == [(1, 3, "running"), (2, 1, "running")]
    after = {r["job_id"]: r for r in jobs.failed(running, F.lit("boom"), now).collect()}
    assert after[1]["status"] == "failed" and after[2]["status"] == "queued" and after[2]["run_after"] == NOW + dt.timedelta(seconds=2)
    more = jobs.enqueue(queue, spark.createDataFrame([(9, 9, "delta")], "document_id long, version_id long, stage string"))
    assert more.where("document_id = 9 AND job_id > 3 AND status = 'queued'").count() == 1
    stages = spark.createDataFrame([("extract", 1), ("extract", 2), ("index", 1), ("enrich", 1), ("summarize", 1)], "stage string, v int")
    assert [r[0] for r in stages.select(jobs.next_stage(F.col("stage"), F.col("v"))).collect()] == ["index", "delta", "enrich", "summarize", None]


def test_index_rows_keep_copies_apart_and_generations_stay(spark, tmp_path):
    docs = documents(spark, [row(1, "One"), row(2, "Two")]).withColumns(
        {"doctype": F.lit("sop"), "effective_date": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("long")}
    )
    versions = spark.createDataFrame([(1, 10, ["c"]), (2, 20, ["c"])], "document_id long, version_id long, chunk_manifest array<string>")
    chunks = spark.createDataFrame([(1, "c", "text", ["H"], 1, [1.0]), (2, "c", "text", ["H"], 1, [1.0])], "document_id long, chunk_id string, text string, heading_path array<string>, page_from int, embedding array<double>")
    nodes = spark.createDataFrame([(1, "n", 1, "sum", [1.0])], "document_id long, node_id string, level int, summary_text string, embedding array<double>")
    tags = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "document_id long, tag_name string")
    rows = index_store.passage_rows(docs, versions, chunks, nodes, tags)
    assert sorted((r["document_id"], r["chunk_id"], r["level"], tuple(r["tags"])) for r in rows.collect()) == [(1, "c", 0, ("a", "b")), (1, "n", 1, ("a", "b")), (2, "c", 0, ())]
    folder = index_store.write_generation(rows, index_store.title_rows(docs, tags), str(tmp_path / "index"), 1)
    stored = index_store.read_passages(spark, folder)
    assert index_store.delete_passages(stored, spark.createDataFrame([(1,)], "document_id long")).count() == 1
    assert index_store.upsert_passages(stored, stored.where("document_id = 1 AND level = 0")).count() == 2
    with pytest.raises(ValueError):
        index_store.write_generation(rows, rows, str(tmp_path / "index"), 1)
