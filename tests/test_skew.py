import random

import pandas as pd
from pyspark.sql import functions as F

from docloom.functions.skew import attach_per_key, previous_value, running_number


def rows(spark, n=600):
    random.seed(1)
    # A third of all rows share one key.
    data = [(i, "hot" if i % 3 == 0 else f"k{random.randint(0, 80)}", random.random()) for i in range(n)]
    return data, spark.createDataFrame(data, "id long, key string, v double")


def test_attach_per_key(spark):
    data, df = rows(spark)
    facts = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    for share in (3, 20, 1000):
        made = attach_per_key(df, facts, ["key"], "n", "id", share).collect()
        frame = pd.DataFrame(data, columns=["id", "key", "v"])
        expected = {r.id: (n, f) for r, n, f in zip(frame.itertuples(), frame.groupby("key").id.transform("count"), frame.groupby("key").id.transform("min"))}
        assert {r["id"]: (r["n"], r["first"]) for r in made} == expected


def test_attach_keeps_unmatched(spark):
    _, df = rows(spark, 60)
    facts = df.where("key = 'hot'").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    kept = attach_per_key(df, facts, ["key"], "n", "id", 1000, keep_unmatched=True)
    assert kept.count() == 60 and kept.where("n IS NULL").count() == 40


def test_blocked_windows_match_plain_ones(spark):
    data, df = rows(spark)
    block = F.floor(F.col("id") / 37)
    numbered = {r["id"]: r["n"] for r in running_number(df, ["key"], block, [F.col("id")], "n").collect()}
    looked = {r["id"]: (r["prev_id"], r["prev_v"]) for r in previous_value(df, ["key"], "id", block, ["v"]).collect()}
    frame = pd.DataFrame(data, columns=["id", "key", "v"]).sort_values("id")
    frame["n"] = frame.groupby("key").cumcount() + 1
    grouped = frame.groupby("key")
    frame["pid"], frame["pv"] = grouped.id.shift(), grouped.v.shift()
    assert numbered == dict(zip(frame.id, frame.n))
    assert looked == {r.id: (None, None) if pd.isna(r.pid) else (int(r.pid), r.pv) for r in frame.itertuples()}


def test_hot_rows_are_dealt_over_partitions(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("key"))
    facts = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keep = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        made = attach_per_key(df, facts, ["key"], "n", "id", keep_unmatched=True)
        places = made.where("key = 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for name, value in keep.items():
            spark.conf.set(name, value)
    assert len(places) == 4 and sum(r["count"] for r in places) == 2000
