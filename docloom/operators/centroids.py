"""Tag centroids kept as sums: confirming or removing a link adds or takes away one vector.

The state of a tag is the sum of the unit-free vectors of its confirmed documents and their number. Changes are summed up for each tag inside
tasks before the shuffle, so a tag with very many changes, or with very many documents, never gathers them, and documents that
did not change are not read again.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.skew import attach_per_key
from docloom.functions.vectors import unit
from docloom.session import cut_lineage

REST = 1e-9  # share of the largest part below which a part of a sum is what rounding has left


def apply_changes(links: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links after confirmations and removals, and what that does to the centroids: ``(tag_id, document_id, step)``.

    ``links`` is ``(document_id, tag_id, source, status)``, ``changes`` is ``(document_id, tag_id, action, at)`` with the action confirm
    or remove; the last action for a link counts. Confirming an unknown link makes one; confirming what is confirmed and
    removing what isn't there do nothing. step is 1 or -1.
    """
    on = ["document_id", "tag_id"]
    last = changes.groupBy(on).agg(F.max_by("action", F.struct("at", "action")).alias("action"))
    before = links.groupBy(on).agg(F.max_by(F.struct("source", "status"), F.col("status") == "confirmed").alias("old"))
    both = cut_lineage(before.join(last, on, "full_outer"))
    was, confirmed = F.coalesce(F.col("old.status") == "confirmed", F.lit(False)), F.col("action") == "confirm"
    steps = both.where(F.col("action").isNotNull()).select("tag_id", "document_id", F.when(confirmed & ~was, 1).when((F.col("action") == "remove") & was, -1).alias("step")).where("step is not null")
    kept = both.where(F.col("action").isNull() | confirmed).select(
        *on, F.when(confirmed & ~was, F.lit("user")).otherwise(F.col("old.source")).alias("source"), F.when(confirmed, F.lit("confirmed")).otherwise(F.col("old.status")).alias("status")
    )
    return kept, steps


def advanced(state: DataFrame | None, steps: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(tag_id, sums, n)`` after the steps; a tag without confirmed vectors leaves the state.

    ``vectors`` is ``(document_id, vector)``; null and empty vectors don't count, nor those of another length than the tag's sums (for
    a new tag: than the vector of its smallest document).
    """
    known = vectors.where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    moved = steps.join(known, "document_id").select("tag_id", "document_id", "step", F.col("vector").cast("array<double>").alias("vector"))
    sizes = moved.groupBy("tag_id").agg(F.min_by(F.size("vector"), "document_id").alias("_first"), F.count("*").alias("_n"))
    if state is not None:
        sizes = sizes.join(state.select("tag_id", F.size("sums").alias("_held")), "tag_id", "left").withColumn("_first", F.coalesce("_held", "_first")).drop("_held")
    same = attach_per_key(moved, cut_lineage(sizes), ["tag_id"], "_n", "document_id").where(F.size("vector") == F.col("_first"))
    signed = F.transform("vector", lambda x: x * F.col("step"))
    change = same.groupBy("tag_id").agg(Summarizer.sum(array_to_vector(signed)).alias("_sum"), F.sum("step").alias("n")).select("tag_id", vector_to_array("_sum").alias("sums"), "n")
    if state is None:
        return change.where("n > 0")
    old = state.select("tag_id", F.col("sums").alias("_sums"), F.col("n").alias("_n"))
    total = F.when(F.col("_sums").isNull(), F.col("sums")).when(F.col("sums").isNull(), F.col("_sums")).otherwise(F.zip_with("_sums", "sums", lambda a, b: a + b))
    joined = old.join(change, "tag_id", "full_outer")
    return joined.select("tag_id", total.alias("sums"), (F.coalesce("_n", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")


def centroids(state: DataFrame) -> DataFrame:
    """``(tag_id, centroid)``: the mean of unit length; a tag whose vectors cancel out has none."""
    largest = F.array_max(F.transform("sums", F.abs))
    clean = F.transform("sums", lambda x: F.when(F.abs(x) > REST * F.least(F.col("n"), F.lit(1)), x).otherwise(0.0))
    return state.where(largest > REST).select("tag_id", unit(clean).alias("centroid"))
