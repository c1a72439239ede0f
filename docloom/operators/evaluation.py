"""Relevance evaluation: does the expected document appear among the first results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage
from docloom.settings import DEFAULTS, Settings

TOP = 5
TARGET = 0.9
SPACE = r"\s+"


def hits(results: DataFrame, expected: DataFrame, top: int = TOP) -> DataFrame:
    """``(query_id, category, hit, rank)``; ``expected`` may list several right documents per query."""
    right = expected.select("query_id", "document_id").distinct()
    found = results.where(F.col("rank") <= top).join(right, ["query_id", "document_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    asked = expected.groupBy("query_id").agg(F.min("category").alias("category"))
    return asked.join(found, "query_id", "left").withColumn("hit", F.col("rank").isNotNull().cast("int"))


def hit_rates(scored: DataFrame, target: float = TARGET) -> DataFrame:
    """Hits, total and rate per category and overall (category ``overall``) with the pass mark."""
    rates = scored.rollup("category").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("total"), F.grouping("category").alias("_all"))
    rate = F.round(F.col("hits") / F.col("total"), 6)
    return rates.select(
        F.when(F.col("_all") == 1, "overall").otherwise(F.col("category")).alias("category"), "hits", "total", rate.alias("rate"), (rate >= target).alias("passed")
    )


def containing(documents: DataFrame, passages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(query_id, passage, document_id)`` for every document whose text contains the whole passage.

    All words of a passage but the first and the last stand between blanks in any text that holds it. The one of them that the fewest passages
    have is looked up among the different words of the texts, an equi-join; the full text decides. Passages of less than three words are compared with every text.
    """
    words = F.split("passage", SPACE)
    asked = cut_lineage(passages.select("query_id", "passage", F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))).alias("inner")))
    inner = asked.select("query_id", "passage", F.explode("inner").alias("word"))
    common = inner.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct("n", (-F.length("word")).alias("shortness"), "word"))["word"].alias("word")
    anchored = cut_lineage(inner.join(common, "word").groupBy("query_id", "passage").agg(rarest))

    total = anchored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0)).alias("bytes")).first()
    found_words = F.explode(F.array_distinct(F.split("text", SPACE))).alias("word")
    if total["n"] <= settings.broadcast_query_rows and total["bytes"] <= settings.broadcast_query_bytes:
        # Checked: passages within both limits go to the texts, which are read once and not shuffled.
        near = documents.select("document_id", "text", found_words).join(F.broadcast(anchored), "word")
    else:
        near = documents.select("document_id", found_words).join(anchored, "word").drop("word").join(documents.select("document_id", "text"), "document_id")
    found = near.where(F.contains("text", F.col("passage"))).select("query_id", "passage", "document_id")

    short = asked.where("size(inner) = 0").select("query_id", "passage")
    if not short.isEmpty():
        found = found.unionByName(documents.join(short, F.contains("text", F.col("passage"))).select("query_id", "passage", "document_id"))
    return found
