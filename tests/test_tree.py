import random

import numpy as np
from pyspark.sql import functions as F

from docloom.functions.vectors import hash_embedder
from docloom.operators import tree
from docloom.settings import Settings

SMALL = Settings(embed_dim=64)


def leaves(spark, sizes):
    random.seed(2)
    rows = []
    for doc, count in sizes.items():
        for i in range(count):
            topic = i % 5
            text = " ".join(random.choices([f"topic{topic}word{j}" for j in range(6)], k=20))
            rows.append((doc, f"{doc}:c{i:02d}", i, text))
    return spark.createDataFrame(rows, "document_id string, chunk_id string, ord int, text string").withColumn("embedding", hash_embedder(64)("text"))


def by_document(nodes):
    found = {}
    for r in nodes.collect():
        found.setdefault(r["document_id"], []).append(r)
    return found


def test_clusters_partition_the_members():
    random.seed(0)
    for count in (0, 1, 3, 4, 5, 12, 40):
        centres = np.random.default_rng(1).normal(size=(4, 16)) * 5
        vectors = [(centres[i % 4] + np.random.default_rng(i).normal(size=16) * 0.1).tolist() for i in range(count)]
        groups = tree.cluster(vectors)
        assert sorted(i for g in groups for i in g) == list(range(count))
        assert [g[0] for g in groups] == sorted(g[0] for g in groups)
        if count == 40:  # far-apart topics never share a group (how finely one topic splits is up to the criterion)
            assert len(groups) >= 4 and all(len({i % 4 for i in g}) == 1 for g in groups)


def test_tree_shape(spark):
    made = by_document(tree.build_tree(leaves(spark, {"s": 5, "m": 12, "l": 30}), settings=SMALL))
    assert len(made["s"]) == 1 and made["s"][0]["level"] == 1 and len(made["s"][0]["children"]) == 5
    for doc, count in (("m", 12), ("l", 30)):
        nodes = made[doc]
        leaf_children = sorted(c for n in nodes if n["level"] == 1 for c in n["children"])
        assert leaf_children == [f"{doc}:c{i:02d}" for i in range(count)]
        top = max(n["level"] for n in nodes)
        assert 2 <= top <= 3 and sum(n["level"] == top for n in nodes) == 1
        assert all(n["summary_text"].startswith("Summary: ") and len(n["embedding"]) == 64 for n in nodes)
        below = {n["node_id"] for n in nodes if n["level"] < top}
        assert below == {c for n in nodes if n["level"] > 1 for c in n["children"]}
    assert {r["document_id"] for r in tree.roots(tree.build_tree(leaves(spark, {"s": 5}), settings=SMALL)).collect()} == {"s"}


def test_refresh_touches_only_what_changed(spark):
    chunks = leaves(spark, {"d": 30, "tiny": 4})
    nodes = tree.build_tree(chunks, settings=SMALL)
    before = {n["node_id"]: n for n in by_document(nodes)["d"]}
    gone, new_id = "d:c03", "d:c99"
    extra = spark.createDataFrame([("d", new_id, 30, "topic2word1 topic2word2 topic2word3")], "document_id string, chunk_id string, ord int, text string")
    after_chunks = chunks.where(F.col("chunk_id") != gone).unionByName(extra.withColumn("embedding", F.lit(None).cast("array<double>")))
    edit = lambda i: spark.createDataFrame([("d", i)], "document_id string, chunk_id string")
    none = spark.createDataFrame([], "document_id string, node_id string")
    made = tree.refresh_tree(nodes, after_chunks, none, edit(new_id), edit(gone), settings=SMALL)
    after = {n["node_id"]: n for n in by_document(made)["d"]}
    assert set(after) <= set(before)
    held = sorted(c for n in after.values() if n["level"] == 1 for c in n["children"])
    assert held == sorted([f"d:c{i:02d}" for i in range(30) if i != 3] + [new_id])
    touched = {i for i, n in after.items() if n["refreshed"]}
    changed = {i for i, n in after.items() if n["level"] == 1 and n["children"] != before[i]["children"]}
    assert changed <= touched and len(touched) < len(after)
    top = max(after.values(), key=lambda n: n["level"])
    assert top["node_id"] in touched
    assert all(after[i]["summary_text"] == before[i]["summary_text"] for i in set(after) - touched)
    assert [n["level"] for n in by_document(made)["tiny"]] == [1]


def test_refresh_rebuilds_small_or_rootless(spark):
    chunks = leaves(spark, {"d": 12})
    empty = spark.createDataFrame([], ", ".join(["document_id string", "node_id string", "level int", "children array<string>", "summary_text string", "embedding array<double>"]))
    none = spark.createDataFrame([], "document_id string, chunk_id string")
    made = tree.refresh_tree(empty, chunks, spark.createDataFrame([], "document_id string, node_id string"), none, none, settings=SMALL)
    rebuilt = by_document(made)["d"]
    assert len(rebuilt) > 1 and all(n["refreshed"] for n in rebuilt)
