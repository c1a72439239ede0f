"""Each Python step of a summary tree runs once, and its clusters are those of mixtures fitted one at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.vectors import hash_embedder
from docloom.operators import chunking, tree
from docloom.settings import Settings
from docloom.sources.tables import spread

SMALL = Settings(chunk_target_tokens=60, chunk_max_tokens=80, embed_dim=64)


def documents(spark):
    text = "\n".join(" ".join(f"w{i * j % 17}" for j in range(1, 40)) for i in range(1, 15))
    return spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None)], "document_id long, text string")


def chunks(spark):
    blocks = documents(spark).select("document_id", chunking.line_blocks(F.col("text")).alias("blocks"))
    return chunking.chunk_documents(blocks, settings=SMALL)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_drafts_are_made_once(spark):
    assert plan(chunks(spark)).count("drafts(") == 1


def test_every_step_runs_once_and_vectors_leave_python_packed(spark, monkeypatch):
    plans = []
    cut = tree.cut_lineage
    monkeypatch.setattr(tree, "cut_lineage", lambda df: plans.append(plan(df)) or cut(df))
    tree.build_tree(chunks(spark).withColumn("embedding", hash_embedder(64)("text")), settings=SMALL)
    assert len(plans) == SMALL.tree_max_depth
    assert [plans[0].count(step) for step in ("drafts(", "cluster_groups(", "pack_vectors(embed(")] == [1, 1, 1]
    assert [p.count("cluster_groups(") for p in plans] == [1, 1, 0]
    assert plans[0].count("Describe this document") == 1  # the prompt


def fit(data, k, seed=0):
    """One mixture, written out plainly."""
    random, n, d = np.random.default_rng(seed), *data.shape
    centres = data[[random.integers(n)]]
    while len(centres) < k:
        gap = ((data[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
        pick = random.choice(n, p=gap / gap.sum()) if gap.sum() > 0 else random.integers(n)
        centres = np.vstack([centres, data[pick]])
    labels = None
    for _ in range(100):
        nearest = ((data[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        if labels is not None and (nearest == labels).all():
            break
        labels = nearest
        centres = np.array([data[labels == c].mean(axis=0) if (labels == c).any() else centres[c] for c in range(k)])
    weight, before = np.eye(k)[labels], -np.inf
    for _ in range(100):
        mass = weight.sum(axis=0) + 10 * np.finfo(float).eps
        means = weight.T @ data / mass[:, None]
        spread = np.maximum(weight.T @ data**2 / mass[:, None] - means**2, 0) + tree.FLOOR
        logs = np.log(mass / mass.sum()) - 0.5 * (np.log(2 * np.pi * spread).sum(axis=1) + ((data[:, None] - means) ** 2 / spread).sum(axis=2))
        total = logs.max(axis=1) + np.log(np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1))
        weight = np.exp(logs - total[:, None])
        if abs(total.mean() - before) < 1e-3:
            break
        before = total.mean()
    return -2 * total.sum() + (2 * k * d + k - 1) * np.log(n), weight.argmax(axis=1)


@pytest.mark.parametrize("kind", ["spread", "repeated", "equal", "signs"])
def test_clusters_equal_single_fits(kind):
    random = np.random.default_rng(3)
    for count in (4, 5, 9, 17, 24, 40, 90):
        vectors = {
            "spread": random.normal(size=(count, 16)),
            "repeated": random.normal(size=(3, 16))[random.integers(0, 3, count)],
            "equal": np.ones((count, 16)),
            "signs": np.sign(random.normal(size=(count, 16))),
        }[kind]
        upper = max(2, min(8, count // 3, count - 1))
        labels = min((fit(tree._principal(vectors), k) for k in range(2, upper + 1)), key=lambda found: found[0])[1].tolist()
        expected = [[i for i, x in enumerate(labels) if x == label] for label in dict.fromkeys(labels)]
        assert tree.cluster(vectors.tolist()) == expected


def test_packed_vectors_come_back_and_sort_like_the_numbers():
    vectors = [[0.5, -2.0], [0.5, 1e-300], [-1.0, 7.0], [-1.0, -7.0], [0.0, 3.0], [1e300, 0.0], [-1e-300, 0.0], [0.5]]
    packed = tree._packed([*vectors, None])
    back = tree._unpacked(packed)
    assert back[-1] is None and [v.tolist() for v in back[:-1]] == vectors
    assert [v.tolist() for v in tree._unpacked(sorted(packed[:-1]))] == sorted(vectors)


def test_repeated_chunks_keep_numbered_ids(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "a", "b"]), (2, ["a", "b"]), (3, [None, None]), (4, [])], "k int, ids array<string>")
    made = {r["k"]: r["u"] for r in rows.select("k", chunking.unique_ids(F.col("ids")).alias("u")).collect()}
    assert made == {1: ["a", "b", "a:2", "a:3", "b:2"], 2: ["a", "b"], 3: [None, None], 4: []}


def test_a_table_of_one_row_group_is_spread_over_all_cores(spark, tmp_path):
    """It has as many splits as its bytes ask for, and all but one of them read nothing."""
    place = f"{tmp_path}/a folder"
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(place)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        scan = spark.read.parquet(place)
        rows = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert scan.rdd.getNumPartitions() >= 4 and len(rows(scan)) == 1
        made = rows(spread(scan))
        assert len(made) >= 4 and sum(made) == 20_000 and max(made) < 10_000
        many = spark.range(20_000).repartition(8)
        many.write.parquet(f"{tmp_path}/many")
        kept = spark.read.parquet(f"{tmp_path}/many")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        assert spread(kept) is kept
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
