"""Search by stored postings against scoring every passage."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.operators.access import search_filter
from docloom.sources import inverted

INDEX = (
    "document_id bigint, chunk_id string, department_id string, level int, allowed_groups array<string>, doctype string, effective_date string, superseded boolean, title string, text string, heading_path array<string>"
)


def passages(spark, count=240):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    rows = []
    for n in range(count):
        document, department = n // 3, f"d{n // 3 % 4}"
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))
        rows.append((document, f"c{n % 5}", department, n % 2, [department], "policy" if n % 3 else "report", "2024-01-01", n % 7 == 0, " ".join(rng.choice(words) for _ in range(3)), text, [rng.choice(words)]))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    return spark.createDataFrame(rows, INDEX), [" ".join(rng.choice(words) for _ in range(6)) for _ in range(12)]


def expected(index, queries, visible, k, fuzzy=False):
    keyed = index.withColumn("key", F.concat(F.lpad(F.col("document_id").cast("string"), 6, "0"), F.lit("/"), F.col("chunk_id")))
    analyzed = retrieval.analyze_index(keyed.withColumn("chunk_id", F.col("key")))
    found = retrieval.lexical_topk(analyzed, visible, queries, k, fuzzy).collect()
    return sorted((r.query_id, int(r.id.split("/")[0]), r.id.split("/")[1], round(r.score, 5), r["rank"]) for r in found)


def test_stored_postings_equal_a_scan(spark, tmp_path):
    index, texts = passages(spark)
    queries = spark.createDataFrame([*enumerate(texts), (50, "nothing known"), (51, "")], "query_id int, query string")
    place = str(tmp_path / "index")
    inverted.build(index, place, shard_rows=40, block_rows=4)
    groups = ["d0", "d1", "d3"]
    for visible, fuzzy, k in ((None, False, 5), (F.col("level") == 0, False, 3), (F.col("doctype") == "report", True, 4), (F.lit(False), False, 4)):
        got = inverted.topk(spark, place, queries, groups, k, visible, fuzzy).collect()
        both = search_filter(groups) if visible is None else search_filter(groups) & visible
        assert sorted((r.query_id, r.document_id, r.chunk_id, round(r.score, 5), r["rank"]) for r in got) == expected(index, queries, both, k, fuzzy)
    assert spark.read.parquet(f"{place}/blocks").select("shard").distinct().count() > 3


def test_empty_index(spark, tmp_path):
    index, texts = passages(spark)
    place = str(tmp_path / "empty")
    inverted.build(index.where("document_id < 0").unionByName(index.where("document_id = 3")), place)
    queries = spark.createDataFrame([(0, texts[0])], "query_id int, query string")
    assert inverted.topk(spark, place, queries, ["nobody"], 5).collect() == []


def test_only_the_terms_of_a_query_are_read(spark, tmp_path):
    index, _ = passages(spark)
    place = str(tmp_path / "index")
    inverted.build(index, place)
    asked = spark.createDataFrame([("w1",), ("w2",)], "term string")
    blocks = inverted._of_terms(spark.read.parquet(f"{place}/blocks").where(F.col("department_id").isin("d1")), asked)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan and "PartitionFilters: [isnotnull(department_id" in plan or "department_id" in plan.split("PartitionFilters:")[1][:80]
    assert "text" not in blocks.columns


def test_blocks_below_the_bar_are_passed_over():
    rng = np.random.default_rng(3)
    rows, size = [], 20_000
    for term, share in (("rare", 0.002), ("usual", 0.2), ("common", 0.9)):
        docs = np.flatnonzero(rng.random(size) < share)
        tf = rng.integers(1, 4, len(docs))
        for block in range(0, len(docs), 128):
            part = tf[block : block + 128]
            rows.append((1, term, block // 128, docs[block : block + 128].tolist(), part.tolist(), [10] * len(part), float((part / (part + 1.2)).max())))
    names = ["field", "term", "block", "rows", "tfs", "lengths", "best"]
    table = pa.table({name: [r[k] for r in rows] for k, name in enumerate(names)})
    shard = inverted.Shard(table, {1: 10.0}, 1.2, 0.75)
    asked = [(1, "common", 0.1), (1, "rare", 6.0), (1, "usual", 1.5)]
    pruned, full = inverted.Work(), inverted.Work()
    best, plain = shard.scores(asked, 10, None, pruned), shard.scores(asked, 10**9, None, full)
    order = np.lexsort((np.arange(len(plain)), -np.round(plain, 9)))[:10]
    assert (np.lexsort((np.arange(len(best)), -np.round(best, 9)))[:10] == order).all() and np.allclose(best[order], plain[order], atol=1e-12)
    assert full.skipped == 0 and pruned.skipped > 0.5 * full.read


def test_postings_leave_a_task_as_lists(spark):
    """One row for each key that a task holds, not one for each posting, and the sums that the averages need."""
    batches = [
        pa.RecordBatch.from_pydict({"department_id": ["a", "a"], "shard": [0, 0], "row": [low, low + 1], "title": [["x"], []], "text": [["x", "y", "x"], ["y"]]}, schema=pa.schema(
            [("department_id", pa.string()), ("shard", pa.int32()), ("row", pa.int64()), ("title", pa.list_(pa.string())), ("text", pa.list_(pa.string()))]
        ))
        for low in (0, 2)
    ]
    made = pa.Table.from_batches(list(inverted._partial_lists([0, 1])(iter(batches)))).to_pylist()
    lists = {(r["field"], r["term"]): list(zip(r["row"], r["tf"], r["length"])) for r in made}
    assert len(made) == 3
    assert lists == {(0, "x"): [(0, 1, 1), (2, 1, 1)], (1, "x"): [(0, 2, 3), (2, 2, 3)], (1, "y"): [(0, 1, 3), (1, 1, 1), (2, 1, 3), (3, 1, 1)]}
    assert [(sum(r["docs"] for r in made if r["field"] == f), sum(r["words"] for r in made if r["field"] == f)) for f in (0, 1)] == [(2, 2), (4, 8)]
