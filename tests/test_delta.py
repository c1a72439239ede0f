import random

from pyspark.sql import functions as F

from docloom.functions.vectors import hash_embedder
from docloom.operators.delta import apply_versions
from docloom.operators.tree import build_tree
from docloom.settings import Settings

SETTINGS = Settings(embed_dim=64)


def test_one_amended_section_and_one_untouched_document(spark):
    random.seed(4)
    text = lambda i: " ".join(random.choices([f"t{i % 4}w{j}" for j in range(6)], k=20))
    schema = "document_id string, chunk_id string, ord int, text string"
    old = [(d, f"{d}:{i}", i, text(i)) for d in ("a", "b") for i in range(12)]
    new = [r if r[1] != "a:5" else ("a", "a:5x", 5, "t1w1 t1w2 amended") for r in old] + [("fresh", "fresh:0", 0, "brand new text")]
    stored = spark.createDataFrame(old, schema).withColumn("embedding", hash_embedder(64)("text"))
    nodes = build_tree(stored, settings=SETTINGS)
    previous = stored.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda c: c["chunk_id"]).alias("chunk_manifest"))
    made = apply_versions(previous, spark.createDataFrame(new, schema), stored, nodes, SETTINGS)
    stats = {r["document_id"]: r for r in made.statistics.collect()}
    assert (stats["a"]["added"], stats["a"]["removed"], stats["a"]["reused"], stats["a"]["reembedded"], stats["a"]["reenrich"]) == (1, 1, 11, 1, False)
    assert (stats["b"]["added"], stats["b"]["reused"], stats["b"]["reembedded"], stats["b"]["nodes_refreshed"]) == (0, 12, 0, 0)
    assert (stats["fresh"]["added"], stats["fresh"]["reembedded"], stats["fresh"]["nodes_refreshed"], stats["fresh"]["reenrich"]) == (1, 1, 1, True)
    total = made.nodes.where("document_id = 'a'").count()
    assert 1 < stats["a"]["nodes_refreshed"] <= total
    assert {r["document_id"] for r in made.summaries.collect()} == {"a", "b", "fresh"}
    assert made.chunks.where("embedding IS NULL").count() == 0
    before = {r["node_id"]: r["summary_text"] for r in nodes.where("document_id = 'b'").collect()}
    assert {r["node_id"]: r["summary_text"] for r in made.nodes.where("document_id = 'b'").collect()} == before
