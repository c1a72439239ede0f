"""Typed-ahead title and tag suggestions, and spelling suggestions, for one typed text.

The typed text is a constant of the plan, so every title is scored where it lies and only the best
few rows of each task travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.skew import top_per_key
from docloom.functions.text import (
    auto_distance, char_grams, cjk_terms, edge_grams, let, normalize, plain_terms, term_shingles, within_edits,
)
from docloom.operators.access import allowed
from docloom.settings import DEFAULTS, Settings

# How much each kind of match counts.
EXACT, PHRASE_PREFIX, EDGE, TRIGRAM, FUZZY, CJK = 10.0, 6.0, 3.0, 1.0, 0.5, 2.0
TRIGRAM_SHARE = 0.7
FUZZY_PREFIX = 2


def title_index(documents: DataFrame) -> DataFrame:
    """Titles with the term arrays every suggestion clause looks at."""
    plain = plain_terms(F.col("title"))
    return documents.withColumns(
        {
            "plain": plain,
            "edge": edge_grams(plain),
            "tri": char_grams(plain),
            "cjk": F.array_distinct(cjk_terms(F.col("title"))),
            "shingle": F.array_distinct(term_shingles(plain)),
        }
    )


def _share(asked: Column, have: Column) -> Column:
    """Which part of the asked terms the title has."""
    hits = let(have, lambda known: F.size(F.filter(asked, lambda t: F.array_contains(known, t))))
    return F.when(F.size(asked) > 0, hits / F.size(asked)).otherwise(F.lit(0.0))


def match_score(text: str) -> Column:
    """Sum over the clauses that match; each counts its weight times the part of the text it covers."""
    typed = F.lit(text)
    asked = plain_terms(typed)
    last = F.element_at(asked, -1)
    ahead = F.slice(asked, F.lit(1), F.size(asked) - 1)
    starts = F.sequence(F.lit(1), F.greatest(F.size("plain") - F.size(asked) + 1, F.lit(1)))
    phrase = (F.size("plain") >= F.size(asked)) & F.exists(
        starts,
        lambda i: (F.slice(F.col("plain"), i, F.size(asked) - 1) == ahead)
        & F.startswith(F.coalesce(F.get(F.col("plain"), i + F.size(asked) - 2), F.lit("")), last),
    )
    grams = char_grams(asked)
    tri = _share(grams, F.col("tri"))

    def near(term: Column) -> Column:
        prefix = F.substring(term, 1, FUZZY_PREFIX)
        return F.exists(F.col("plain"), lambda w: F.startswith(w, prefix) & within_edits(term, w, auto_distance(term)))

    fuzzy = F.when(F.size(asked) > 0, F.size(F.filter(asked, near)) / F.size(asked)).otherwise(F.lit(0.0))
    return (
        F.when(F.col("title") == typed, EXACT).otherwise(0.0)
        + F.when((F.size(asked) > 0) & phrase, PHRASE_PREFIX).otherwise(0.0)
        + EDGE * _share(asked, F.col("edge"))
        + F.when(tri >= TRIGRAM_SHARE, TRIGRAM * tri).otherwise(0.0)
        + FUZZY * fuzzy
        + CJK * _share(cjk_terms(typed), F.col("cjk"))
    )


def suggest_documents(titles: DataFrame, text: str, groups: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Best titles for the typed text: ``(document_id, title, doctype, department_id, score)``."""
    text = text.strip()
    scored = titles.where(allowed(groups)).withColumn("score", F.round(match_score(text), 6))
    rows = scored.where(F.col("score") > 0).select("document_id", "title", "doctype", "department_id", "score")
    if len(text) < settings.suggest_min_chars:
        return rows.limit(0)
    return rows.orderBy(F.col("score").desc(), F.col("document_id")).limit(settings.suggest_documents)


def suggest_tags(titles: DataFrame, tags: DataFrame, text: str, groups: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Tags in order: frequent on matching titles and containing the text, any containing it, the other frequent ones.

    ``titles`` carries a ``tags`` array; ``tags`` is the visible tag table ``(tag_id, name)``.
    """
    text = text.strip()
    matching = titles.where(allowed(groups) & (match_score(text) > 0))
    counted = matching.select(F.explode(F.array_distinct("tags")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    frequent = counted.orderBy(F.col("n").desc(), F.col("name")).limit(settings.suggest_tags)
    return ordered_tags(frequent, tags, text, settings)


def ordered_tags(frequent: DataFrame, tags: DataFrame, text: str, settings: Settings = DEFAULTS) -> DataFrame:
    """The tags of ``suggest_tags``, given the frequent ones of the matching titles as ``(name, n)``."""
    text = text.strip()
    needle = text.lower()
    first = tags.groupBy(F.lower("name").alias("key")).agg(F.min_by(F.struct("tag_id", "name"), F.col("tag_id")).alias("tag"))
    contains = F.contains(F.lower("name"), F.lit(needle))
    tiers = (
        frequent.where(contains).select(F.lower("name").alias("key"), F.lit(0).alias("tier"), (-F.col("n")).alias("weight"))
        .unionByName(tags.where(contains).select(F.lower("name").alias("key"), F.lit(1).alias("tier"), F.lit(0).cast("long").alias("weight")))
        .unionByName(frequent.select(F.lower("name").alias("key"), F.lit(2).alias("tier"), (-F.col("n")).alias("weight")))
    )
    best = tiers.groupBy("key").agg(F.min(F.struct("tier", "weight", "key")).alias("place"))
    named = best.join(first, "key").select("tag.tag_id", "tag.name", "place")
    if len(text) < settings.suggest_min_chars:
        return named.limit(0).select("tag_id", "name")
    return named.orderBy("place").limit(settings.suggest_tags).select("tag_id", "name")


def did_you_mean(titles: DataFrame, queries: DataFrame, groups: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """``(query_id, suggestion)``: each word replaced by its nearest title word the caller can see.

    Nearest means fewest edits, then most titles, then alphabetical. A suggestion equal to the query is
    dropped, and so is one none of whose words occur in a visible title.
    """
    from docloom.operators.retrieval import fuzzy_terms

    words = (
        titles.where(allowed(groups)).select(F.explode(F.array_distinct("plain")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    )
    asked = queries.select("query_id", "query", F.posexplode(plain_terms(F.col("query"))).alias("pos", "asked"))
    near = fuzzy_terms(words.select("term"), asked.select("asked")).join(words, "term")
    best = top_per_key(near, ["asked"], [F.col("distance"), F.col("df").desc(), F.col("term")], 1, "_n").select("asked", F.col("term").alias("word"))
    replaced = asked.join(best, "asked", "left")
    pieces = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("word", "asked").alias("w")))), lambda p: p["w"]
    )
    joined = replaced.groupBy("query_id", "query").agg(F.array_join(pieces, " ").alias("suggestion"), F.count("word").alias("known"))
    different = normalize(F.col("suggestion")) != normalize(F.col("query"))
    return joined.where(different & (F.col("known") > 0)).select("query_id", "suggestion")
