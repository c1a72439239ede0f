"""Numbered sources, prompts and the mapping of ``[n]`` marks back to passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip
from docloom.session import cut_lineage
from docloom.settings import DEFAULTS, Settings

FALLBACK_CITATIONS = 3
UNTITLED = "Untitled document"


def cited_numbers(answer: Column) -> Column:
    """Distinct numbers of ``[1]`` or ``[1, 2]`` marks in order of appearance."""
    marks = F.regexp_extract_all(answer, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(marks, lambda m: F.transform(F.split(m, ","), lambda n: strip(n).cast("int")))))


def map_citations(answers: DataFrame, hits: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``answers(query_id, answer)`` joined to the ranked ``hits``; out-of-range marks drop out.

    An answer with no valid mark cites its first three sources.
    """
    hits = cut_lineage(hits.drop("position"))  # a few rows per query, read twice
    marks = answers.select("query_id", F.posexplode(cited_numbers(F.col("answer"))).alias("position", "rank"))
    valid = marks.join(hits, ["query_id", "rank"])
    silent = answers.select("query_id").join(valid.select("query_id").distinct(), "query_id", "left_anti")
    fallback = hits.where(F.col("rank") <= FALLBACK_CITATIONS).join(silent, "query_id").withColumn("position", F.col("rank") - 1)
    return valid.unionByName(fallback).select(
        "query_id",
        "position",
        F.col("rank").alias("n"),
        "document_id",
        F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit(UNTITLED)).alias("title"),
        "chunk_id",
        F.col("page_from").alias("page"),
        F.substring("text", 1, settings.quote_chars).alias("quote"),
    )


def source_block(number: Column, title: Column, page: Column, heading_path: Column, level: Column, superseded: Column, text: Column) -> Column:
    header = F.concat_ws(
        " | ",
        F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(F.when(title != "", title), F.lit(UNTITLED))),
        F.concat(F.lit("page "), page.cast("string")),
        F.when(F.size(heading_path) > 0, F.array_join(heading_path, " > ")),
        F.when(level > 0, F.lit("document summary")),
        F.when(superseded, F.lit("SUPERSEDED by a newer document")),
    )
    return F.concat(header, F.lit("\n"), strip(text))


def numbered_sections(texts: Column, limit: int) -> Column:
    """``[i]`` sections joined by blank lines, cut where ``limit`` characters are used up."""
    stripped = F.transform(texts, strip)
    state = F.aggregate(
        stripped,
        F.struct(F.array().cast("array<string>").alias("parts"), F.lit(limit).alias("left")),
        lambda acc, t: F.struct(
            F.when(
                acc["left"] > 0,
                F.concat(
                    acc["parts"],
                    F.array(F.concat(F.lit("["), (F.size(acc["parts"]) + 1).cast("string"), F.lit("]\n"), F.substr(t, F.lit(1), acc["left"]))),
                ),
            ).otherwise(acc["parts"]).alias("parts"),
            F.greatest(acc["left"] - F.length(t), F.lit(0)).alias("left"),
        ),
    )
    return F.array_join(state["parts"], "\n\n")
