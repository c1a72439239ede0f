"""Spark helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.registry import Query
from docloom.session import cut_lineage

#: Name -> query and name -> SQL of this package; the entry module adds them to its own.
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Rows and bytes handed to Python at once; texts can be long, so batches are kept short.
BATCH_ROWS, BATCH_BYTES = "1000", "16m"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def ready(spark: SparkSession) -> None:
    """Session settings that the operators count on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def at_least(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the named columns, so that other columns with clashing names do no harm; missing rows are no error."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def row_key() -> Column:
    """A hash of doc_id and text: rows share it only where both are equal (null ids are equal, a null text is an empty one)."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))), 256))


def connected(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) of each node that has an edge; root is the smallest node that can be reached.

    Alternating large-star and small-star steps: each joins a node with the smallest of its neighbours, so
    that a node never gathers its neighbours in one task and rows never outnumber the edges. Each step is
    written before the next one, and the loop ends when a step changes nothing.
    """
    now = cut_lineage(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut_lineage(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut_lineage(small.select("e.*").where("u <> v").distinct())
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        seen = state
