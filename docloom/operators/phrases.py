"""Spelling suggestions for whole phrases: a lattice of near words, weighed by how title words follow each other.

Each word of a query has a few candidates: near words of the titles the caller can read, and itself. A path through the lattice scores
the sum of the logarithms of how likely each word was meant (more edits: less) and of how likely it follows the two words before
it, by counts of word triples in the titles with backoff to pairs and single words. Counts are looked up by joins for the triples
that the lattice has, and the best path of a query is found by dynamic programming over its last two words.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.skew import top_per_key
from docloom.functions.text import normalize, plain_terms, term_shingles
from docloom.operators.access import allowed
from docloom.operators.retrieval import fuzzy_terms
from docloom.session import cut_lineage

# Candidates of a word, the chance that a known word is meant as it stands, and the discount of each backoff.
CANDIDATES, AS_TYPED, BACKOFF = 5, 0.95, 0.4


def ngram_counts(titles: DataFrame) -> DataFrame:
    """``(gram, n)`` of all runs of one to three words of ``plain``, joined by blanks."""
    return titles.select(F.explode(term_shingles(F.col("plain"), 2, 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def meant(asked: Column, word: Column, distance: Column) -> Column:
    """Logarithm of how likely a word was meant."""
    return F.log(F.when(asked == word, F.lit(AS_TYPED)).otherwise((1 - AS_TYPED) * (1 - distance / (F.length(asked) + 1))))


def lattice(counts: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, query, pos, word, cost, known)``: the candidates of each word of each query."""
    asked = cut_lineage(queries.select("query_id", "query", F.posexplode(plain_terms(F.col("query"))).alias("pos", "asked")))
    words = counts.where(~F.contains("gram", F.lit(" "))).select(F.col("gram").alias("term"), "n")
    near = fuzzy_terms(words.select("term"), asked.select("asked")).join(words, "term")
    best = top_per_key(near, ["asked"], [F.col("distance"), F.col("n").desc(), F.col("term")], CANDIDATES, "_r")
    found = best.select("asked", F.col("term").alias("word"), meant(F.col("asked"), F.col("term"), F.col("distance")).alias("cost"), F.lit(True).alias("known"))
    itself = asked.select("asked").distinct().join(words.select(F.col("term").alias("asked")), "asked", "left_anti")
    unknown = itself.select("asked", F.col("asked").alias("word"), F.log(F.lit(AS_TYPED)).alias("cost"), F.lit(False).alias("known"))
    return asked.join(found.unionByName(unknown), "asked").select("query_id", "query", "pos", "word", "cost", "known")


def follows(counts: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(query_id, pos, one, two, word, score)``: each run of up to three neighbouring candidates, with the score of its last word."""
    total = counts.where(~F.contains("gram", F.lit(" "))).agg(F.sum("n").alias("total"))
    last = candidates.select("query_id", "pos", "word", "cost")
    before = lambda k, name: last.select("query_id", (F.col("pos") + k).alias("pos"), F.col("word").alias(name))
    runs = last.join(before(1, "two"), ["query_id", "pos"], "left").join(before(2, "one"), ["query_id", "pos"], "left")
    grams = {"n3": ["one", "two", "word"], "n12": ["one", "two"], "n23": ["two", "word"], "n2": ["two"], "n1": ["word"]}
    for name, parts in grams.items():
        # Null where one of the words is missing: such a run meets nothing.
        key = F.concat_ws(" ", *parts)
        whole = F.when(F.greatest(*[F.col(p).isNull() for p in parts], F.lit(False)), F.lit(None)).otherwise(key)
        runs = runs.withColumn("gram", whole).join(counts.select("gram", F.col("n").alias(name)), "gram", "left").drop("gram")
    alone = F.coalesce("n1", F.lit(0.5)) / F.col("total")
    pair = F.when(F.col("two").isNull(), alone).otherwise(F.when(F.col("n23") > 0, F.col("n23") / F.col("n2")).otherwise(BACKOFF * alone))
    triple = F.when(F.col("one").isNull(), pair).otherwise(F.when(F.col("n3") > 0, F.col("n3") / F.col("n12")).otherwise(BACKOFF * pair))
    return runs.join(F.broadcast(total)).select("query_id", "pos", "one", "two", "word", (F.log(triple) + F.col("cost")).alias("score"))  # one row


def best_path(runs: list[tuple[int, str | None, str | None, str, float]]) -> str:
    """Words of the best path, ties by alphabet; runs are (pos, one, two, word, score).

    Sums stay as they are and only comparisons round: paths that tie often have different steps, whose rounded values add up differently.
    """

    def better(way: tuple[float, tuple[str, ...]]) -> tuple[float, tuple[str, ...]]:
        return -round(way[0], 9), way[1]

    states: dict[tuple[str | None, str | None], tuple[float, tuple[str, ...]]] = {(None, None): (0.0, ())}
    by_place: dict[int, list] = {}
    for run in runs:
        by_place.setdefault(run[0], []).append(run[1:])
    for pos in sorted(by_place):
        now: dict = {}
        for one, two, word, score in by_place[pos]:
            if (one, two) in states:
                total, words = states[one, two]
                way = (total + score, (*words, word))
                if (two, word) not in now or better(way) < better(now[two, word]):
                    now[two, word] = way
        states = now
    return " ".join(min(states.values(), key=better)[1])


def correct(titles: DataFrame, queries: DataFrame, groups: list[str]) -> DataFrame:
    """``(query_id, suggestion)``: the best phrase for each query, where it differs from the query and has a word of a readable title.

    ``titles`` has ``plain`` and ``allowed_groups``; queries without words get nothing.
    """
    counts = cut_lineage(ngram_counts(titles.where(allowed(groups))))
    candidates = cut_lineage(lattice(counts, queries))
    query_type = queries.schema["query_id"].dataType.simpleString()

    def paths(rows: pa.Table) -> pa.Table:
        columns = [rows.column(c).to_pylist() for c in ("pos", "one", "two", "word", "score")]
        return pa.table({"query_id": rows.column("query_id").slice(0, 1), "suggestion": [best_path(list(zip(*columns)))]})

    found = follows(counts, candidates).groupBy("query_id").applyInArrow(paths, f"query_id {query_type}, suggestion string")
    known = candidates.groupBy("query_id").agg(F.first("query").alias("query"), F.bool_or("known").alias("known"))
    different = normalize(F.col("suggestion")) != normalize(F.col("query"))
    return found.join(known, "query_id").where(F.col("known") & different).select("query_id", "suggestion")
