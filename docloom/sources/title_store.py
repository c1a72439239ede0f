"""A stored index of titles for suggestions: words with the places where they stand, laid out by department.

What a typed text matches is decided once for each different word of all titles: by equality, beginning, a common run of
three letters or a few edits. Only the postings of matching words are then counted for each title, so no
title is taken apart again and several typed texts share one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.skew import top_per_key
from docloom.functions.text import auto_distance, char_grams, cjk_terms, plain_terms, within_edits
from docloom.operators.suggest import CJK, EDGE, EXACT, FUZZY, FUZZY_PREFIX, PHRASE_PREFIX, TRIGRAM, TRIGRAM_SHARE
from docloom.settings import DEFAULTS, Settings

EDGES = (2, 20)  # fixed values: typed beginnings of fewer or more letters match no word as such
PLAIN, HANZI = 0, 1


def build(titles: DataFrame, folder: str) -> None:
    """Write titles (``document_id``, ``title``, ``doctype``, ``department_id``) and their words."""
    titles.select("document_id", "title", "doctype", "department_id").write.partitionBy("department_id").parquet(f"{folder}/titles")
    stored = titles.sparkSession.read.parquet(f"{folder}/titles")
    fields = F.array(*[F.struct(F.lit(kind).alias("field"), terms.alias("terms")) for kind, terms in ((PLAIN, plain_terms(F.col("title"))), (HANZI, cjk_terms(F.col("title"))))])
    words = stored.select("document_id", "department_id", F.explode(fields).alias("f")).select("document_id", "department_id", "f.field", F.posexplode("f.terms").alias("place", "word"))
    places = words.groupBy("department_id", "field", "word", "document_id").agg(F.sort_array(F.collect_list("place")).alias("places"))
    places.repartition("department_id", "word").sortWithinPartitions("department_id", "field", "word").write.partitionBy("department_id").parquet(f"{folder}/places")


def _pieces(spark: SparkSession, texts: list[str]) -> tuple[DataFrame, list]:
    """What each typed text looks for: (typed, kind, field, number, piece, edits), and the numbers of pieces of each text."""
    typed = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "typed int, text string")
    terms = typed.select("typed", "text", plain_terms(F.col("text")).alias("plain"), cjk_terms(F.col("text")).alias("cjk"))
    rows = terms.withColumn("tri", char_grams(F.col("plain"))).collect()
    found, sizes = [], []
    for row in rows:
        sizes.append((row.typed, row.text, len(row.plain), len(row.tri), len(row.cjk)))
        for number, term in enumerate(row.plain):
            if EDGES[0] <= len(term) <= EDGES[1]:
                found.append((row.typed, "edge", PLAIN, number, term))
            found.append((row.typed, "near", PLAIN, number, term))
            found.append((row.typed, "last" if number == len(row.plain) - 1 else "same", PLAIN, number, term))
        found += [(row.typed, "tri", PLAIN, number, gram) for number, gram in enumerate(row.tri)]
        found += [(row.typed, "cjk", HANZI, number, term) for number, term in enumerate(row.cjk)]
    return found, sizes


def _meets(piece: Column, field: Column, word: Column) -> Column:
    kind, text = piece["kind"], piece["piece"]
    starts = F.startswith(word, text)
    near = F.startswith(word, F.substring(text, 1, FUZZY_PREFIX)) & within_edits(text, word, auto_distance(text))
    whole = kind.isin("same", "cjk") & (word == text)
    return (piece["field"] == field) & (whole | (kind.isin("edge", "last") & starts) | ((kind == "tri") & F.contains(word, text)) | ((kind == "near") & near))


def scores(spark: SparkSession, folder: str, texts: list[str], groups: list[str]) -> DataFrame:
    """``(typed, document_id, score)`` of every title of the caller's departments that a typed text matches; ``typed`` is its place in the list."""
    pieces, sizes = _pieces(spark, texts)
    mine = F.col("department_id").isin(groups)
    places = spark.read.parquet(f"{folder}/places").where(mine)
    schema = "typed int, kind string, field int, number int, piece string"
    asked = F.from_json(F.lit(_json(pieces)), f"array<struct<{', '.join(c.replace(' ', ': ') for c in schema.split(', '))}>>")
    words = places.select("field", "word").distinct()
    met = words.select("field", "word", F.explode(F.filter(asked, lambda p: _meets(p, F.col("field"), F.col("word")))).alias("p")).select("field", "word", "p.typed", "p.kind", "p.number")
    # Each title once for each piece it meets, then the number of pieces of each kind.
    hits = met.join(places.select("field", "word", "document_id", "places"), ["field", "word"])
    counted = hits.select("typed", "document_id", "kind", "number").distinct().groupBy("typed", "document_id").agg(
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in ("edge", "tri", "near", "cjk")]
    )
    size = spark.createDataFrame(sizes, "typed int, text string, n_plain int, n_tri int, n_cjk int")
    # A phrase starts at the same place for all its words; the last one may go on.
    run = hits.where(F.col("kind").isin("same", "last")).select("typed", "document_id", "number", F.explode(F.transform("places", lambda p: p - F.col("number"))).alias("start"))
    runs = run.distinct().groupBy("typed", "document_id", "start").agg(F.count("*").alias("n"))
    small = F.broadcast(size)  # a row for each typed text
    phrases = runs.join(small, "typed").where(F.col("n") == F.col("n_plain")).select("typed", "document_id").distinct().withColumn("phrase", F.lit(True))
    exact = spark.read.parquet(f"{folder}/titles").where(mine & F.col("title").isin(texts)).join(small, F.col("title") == F.col("text")).select("typed", "document_id").withColumn("exact", F.lit(True))
    joined = counted.join(phrases, ["typed", "document_id"], "full_outer").join(exact, ["typed", "document_id"], "full_outer").join(small, "typed")

    def share(hit: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.coalesce(F.col(hit), F.lit(0)) / F.col(of)).otherwise(F.lit(0.0))

    tri = share("tri", "n_tri")
    score = (
        F.when(F.col("exact"), EXACT).otherwise(0.0)
        + F.when(F.col("phrase"), PHRASE_PREFIX).otherwise(0.0)
        + EDGE * share("edge", "n_plain")
        + F.when(tri >= TRIGRAM_SHARE, TRIGRAM * tri).otherwise(0.0)
        + FUZZY * share("near", "n_plain")
        + CJK * share("cjk", "n_cjk")
    )
    return joined.select("typed", "document_id", F.round(score, 6).alias("score")).where(F.col("score") > 0)


def _json(pieces: list) -> str:
    import json

    return json.dumps([dict(zip(("typed", "kind", "field", "number", "piece"), p)) for p in pieces])


def suggest(spark: SparkSession, folder: str, texts: list[str], groups: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """``(typed, document_id, title, doctype, department_id, score)``: the best titles for each typed text, trimmed; too short ones find none."""
    texts = [t.strip() for t in texts if len(t.strip()) >= settings.suggest_min_chars]
    titles = spark.read.parquet(f"{folder}/titles").where(F.col("department_id").isin(groups))
    best = top_per_key(scores(spark, folder, texts, groups), ["typed"], [F.col("score").desc(), F.col("document_id")], settings.suggest_documents)
    named = F.get(F.array(*[F.lit(t) for t in texts]).cast("array<string>"), F.col("typed")).alias("typed")
    return best.join(titles, "document_id").select(named, "document_id", "title", "doctype", "department_id", "score")


def tags_of_matches(spark: SparkSession, folder: str, texts: list[str], groups: list[str], document_tags: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(typed, name, n)``: the most frequent tags (``document_id``, ``tag_name``) of the titles that each typed text matches."""
    found = scores(spark, folder, texts, groups).join(document_tags.distinct(), "document_id")
    counted = found.groupBy("typed", F.col("tag_name").alias("name")).agg(F.count("*").alias("n"))
    return top_per_key(counted, ["typed"], [F.col("n").desc(), F.col("name")], settings.suggest_tags).drop("rank")
