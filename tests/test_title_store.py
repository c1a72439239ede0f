"""Suggestions from stored words against matching every title."""

import random

from pyspark.sql import functions as F

from docloom.operators import suggest
from docloom.sources import title_store


def test_stored_titles_equal_matching_each_title(spark, tmp_path):
    rng = random.Random(2)
    words = ["annual", "annuel", "leave", "Leaf", "policy", "polices", "Élan", "x", "20", "2024", "年度报告", "报告", "anne", "le", "café", "leave-policy", "an"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 7))), "policy", f"d{i % 3}") for i in range(300)] + [(900, "annual leave", "sop", "d0"), (901, "", "sop", "d1")]
    docs = spark.createDataFrame(rows, "document_id bigint, title string, doctype string, department_id string")
    place = str(tmp_path / "titles")
    title_store.build(docs, place)
    typed = ["annual leave", " annual le ", "anual", "pol", "报告", "élan café x", "x", "20", "!!", "leave annual leave leave", "zzz"]
    index = suggest.title_index(docs.withColumns({"allowed_groups": F.array("department_id"), "tags": F.array("doctype")}))
    groups = ["d0", "d2"]
    got = {}
    for r in title_store.suggest(spark, place, typed, groups).collect():
        got.setdefault(r.typed, []).append((-r.score, r.document_id, r.title))
    for text in typed:
        plain = [(-r.score, r.document_id, r.title) for r in suggest.suggest_documents(index, text, groups).collect()]
        assert sorted(got.get(text.strip(), [])) == sorted(plain), text
    links = docs.select("document_id", F.col("doctype").alias("tag_name"))
    counts = {(r.typed, r.name): r.n for r in title_store.tags_of_matches(spark, place, ["annual leave", "报告"], groups, links).collect()}
    for typed_at, text in enumerate(["annual leave", "报告"]):
        for tag in ("policy", "sop"):
            matching = index.where(F.col("department_id").isin(groups) & (F.col("doctype") == tag) & (suggest.match_score(text) > 0)).count()
            assert counts.get((typed_at, tag), 0) == matching
