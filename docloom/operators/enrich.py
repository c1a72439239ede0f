"""Enrichment of new documents: metadata, title, folder, succession, tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.metadata import offline_enrichment, resolve_doctype
from docloom.functions.skew import attach_per_key, top_per_key
from docloom.functions.text import collapse
from docloom.functions.titles import choose_title, suggest_title
from docloom.functions.vectors import mean_vectors, unit
from docloom.operators.catalog import find_by_reference
from docloom.operators.cells import similar_pairs
from docloom.operators.folders import auto_file
from docloom.settings import DEFAULTS, Settings




def preliminary_titles(documents: DataFrame) -> DataFrame:
    """Give still-untitled documents the best heuristic title right after indexing."""
    found = suggest_title(F.col("embedded_title"), F.col("blocks"), F.col("filename"))
    usable = (F.col("title_source") == "default") & (F.col("_s.source") != "default")
    return documents.withColumn("_s", found).withColumns(
        {
            "title": F.when(usable, F.col("_s.title")).otherwise(F.col("title")),
            "title_source": F.when(usable, F.col("_s.source")).otherwise(F.col("title_source")),
            "title_confidence": F.when(usable, F.col("_s.confidence")).otherwise(F.col("title_confidence")),
        }
    ).drop("_s")


def enrich(
    documents: DataFrame, folders: DataFrame, reply: Callable[[Column, Column], Column] = offline_enrichment, settings: Settings = DEFAULTS
) -> DataFrame:
    """Add type, metadata, title and folder. ``reply(sample, filename)`` is the model port's parsed struct.

    ``documents`` carries ``document_id, department_id, title, title_source, title_confidence, folder_id,
    filename, embedded_title, blocks, sample``; the model sees the first ``enrichment_sample_chars``.
    """
    answered = documents.withColumn("_r", reply(F.substring("sample", 1, settings.enrichment_sample_chars), F.col("filename")))
    typed = answered.withColumn(
        "doctype", resolve_doctype(F.col("_r.doctype"), F.coalesce(F.col("_r.title"), F.col("title")), F.col("filename"), F.col("sample"))
    )
    heuristic = suggest_title(F.col("embedded_title"), F.col("blocks"), F.col("filename"))
    titled = typed.withColumn("_h", heuristic).withColumn("_t", choose_title(F.col("title_source"), F.col("_h"), F.col("_r.title"), settings))
    better = F.col("_t").isNotNull() & (F.col("_t.source") != "default")
    renamed = {
        "title": F.when(better, F.col("_t.title")).otherwise(F.col("title")),
        "title_source": F.when(better, F.col("_t.source")).otherwise(F.col("title_source")),
        "title_confidence": F.when(better, F.col("_t.confidence")).otherwise(F.col("title_confidence")),
    }
    meta = {name: F.col(f"_r.{name}") for name in ("agency", "reference_no", "effective_date", "supersedes_ref", "language")}
    return auto_file(titled.withColumns({**renamed, **meta, "suggested_tags": F.col("_r.tags")}), folders).drop("_r", "_h", "_t")


def supersedes_links(documents: DataFrame) -> DataFrame:
    """``(superseded_id, newer_id)``: a document naming another's reference number replaces it.

    References match without case inside one department; the newest holder is meant, never the
    document itself; several claims on one document leave the latest claimant.
    """
    requests = documents.where(F.col("supersedes_ref").isNotNull()).select(
        "document_id", "department_id", F.col("supersedes_ref").alias("reference_no")
    )
    found = find_by_reference(documents, requests)
    return found.groupBy(F.col("found_id").alias("superseded_id")).agg(F.max("document_id").alias("newer_id"))


def apply_supersedes(documents: DataFrame) -> DataFrame:
    links = supersedes_links(documents).select(F.col("superseded_id").alias("document_id"), "newer_id")
    joined = documents.join(links, "document_id", "left")
    return joined.withColumn("superseded_by", F.coalesce("newer_id", "superseded_by")).drop("newer_id")


def tag_centroids(confirmed: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(tag_id, centroid)``: normalised mean of the confirmed documents' vectors, missing vectors skipped.

    Vectors of another size than the first document's are left out; a zero mean gives no centroid.
    """
    known = vectors.where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    linked = confirmed.select("tag_id", "document_id").join(known, "document_id")
    size = linked.groupBy("tag_id").agg(F.min_by(F.size("vector"), F.col("document_id")).alias("_size"), F.count(F.lit(1)).alias("_links"))
    same = attach_per_key(linked, size, ["tag_id"], "_links", "document_id").where(F.size("vector") == F.col("_size"))
    means = mean_vectors(same, ["tag_id"], "vector")
    return means.where(F.exists("mean_vector", lambda x: x != 0)).select("tag_id", unit(F.col("mean_vector")).alias("centroid"))


def centroid_suggestions(vectors: DataFrame, tags: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(document_id, tag_id, similarity)`` for tags whose centroid is close enough.

    ``vectors`` is ``(document_id, department_id, vector)``; a tag without department is open to all. Centroids lie in cells around
    pivots, and a document meets those of the cells within reach of it.
    """
    documents = vectors.select(F.col("document_id").alias("id"), F.col("department_id").alias("scope"), "vector")
    centroids = tags.select(F.col("tag_id").alias("id"), F.col("department_id").alias("scope"), F.col("centroid").alias("vector"))
    close, _ = similar_pairs(documents, centroids, settings.tag_similarity_threshold)
    return close.select(F.col("left_id").alias("document_id"), F.col("right_id").alias("tag_id"), "similarity")


def named_tags(requests: DataFrame, tags: DataFrame) -> DataFrame:
    """``(document_id, tag_id)`` for tag names a model returned, matched ignoring case and spacing.

    ``requests`` is ``(document_id, department_id, names)``; the first tag of a name wins.
    """
    key = F.lower(collapse(F.col("name")))
    asked = requests.select("document_id", "department_id", F.explode("names").alias("name")).withColumn("key", key)
    first = top_per_key(tags.withColumn("key", key), ["key", "department_id"], [F.col("name"), F.col("tag_id")], 1, "_n")
    own = asked.join(first.where(F.col("department_id").isNotNull()).select("key", "department_id", "tag_id", F.col("name").alias("tag_name")), ["key", "department_id"])
    shared = asked.join(first.where(F.col("department_id").isNull()).select("key", "tag_id", F.col("name").alias("tag_name")), "key")
    columns = ["document_id", "key", "tag_id", "tag_name"]
    both = own.select(columns).unionByName(shared.select(columns))
    return both.groupBy("document_id", "key").agg(F.min(F.struct("tag_name", "tag_id")).alias("t")).select("document_id", "t.tag_id").distinct()


def new_tag_links(close: DataFrame, named: DataFrame, existing: DataFrame) -> DataFrame:
    """Suggested links not there yet; a centroid match brings its similarity, a named one none."""
    on = ["document_id", "tag_id"]
    both = close.select(*on, "similarity").unionByName(named.withColumn("similarity", F.lit(None).cast("double")))
    merged = both.groupBy(on).agg(F.max("similarity").alias("similarity"))
    return merged.join(existing.select(on), on, "left_anti").withColumns({"source": F.lit("ai"), "status": F.lit("suggested")})
