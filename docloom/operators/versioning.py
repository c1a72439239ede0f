"""Manifests, deltas between versions and what a change makes stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.merkle import merkle_root
from docloom.functions.skew import previous_value, running_number
from docloom.session import cut_lineage
from docloom.settings import DEFAULTS, Settings

VERSION_BLOCK = 10_000


def added(old: Column, new: Column) -> Column:
    return F.filter(new, lambda c: ~F.array_contains(old, c))


def removed(old: Column, new: Column) -> Column:
    return F.filter(old, lambda c: ~F.array_contains(new, c))


def reused(old: Column, new: Column) -> Column:
    return F.filter(new, lambda c: F.array_contains(old, c))


def plan_delta(pairs: DataFrame, old: str = "old_manifest", new: str = "new_manifest") -> DataFrame:
    """Per row: roots, whether nothing changed, and the three ordered differences (repeats kept).

    A null old manifest is a first version: everything is added. Equal roots skip the comparison.
    """
    old_ids, new_ids = F.col(old), F.col(new)
    none = F.array().cast("array<string>")
    first = old_ids.isNull()
    with_roots = pairs.withColumn("old_root", F.when(~first, merkle_root(old_ids))).withColumn("new_root", merkle_root(new_ids))
    same = F.coalesce(F.col("old_root") == F.col("new_root"), F.lit(False))
    return with_roots.withColumns(
        {
            "unchanged": same,
            "added": F.when(first, new_ids).when(same, none).otherwise(added(old_ids, new_ids)),
            "removed": F.when(first | same, none).otherwise(removed(old_ids, new_ids)),
            "reused": F.when(first, none).when(same, new_ids).otherwise(reused(old_ids, new_ids)),
        }
    )


def diff_rows(old: DataFrame, new: DataFrame, key: str = "document_id", item: str = "chunk_id") -> DataFrame:
    """The same differences on exploded manifests: ``(key, item, change)``.

    Joins on (document, chunk), so one document with very many chunks is spread over all tasks.
    """
    on = [key, item]
    old_set, new_set = old.select(*on).distinct(), new.select(*on).distinct()
    fresh = new.join(old_set, on, "left_anti").withColumn("change", F.lit("added"))
    kept = new.join(old_set, on, "left_semi").withColumn("change", F.lit("reused"))
    gone = old.join(new_set, on, "left_anti").withColumn("change", F.lit("removed"))
    return fresh.unionByName(kept).unionByName(gone)


def delta_statistics(changes: DataFrame, key: str = "document_id") -> DataFrame:
    def total(kind: str) -> Column:
        return F.count_if(F.col("change") == kind)

    return changes.groupBy(key).agg(total("added").alias("added"), total("removed").alias("removed"), total("reused").alias("reused"))


def needs_enrichment(added_count: Column, new_count: Column, settings: Settings = DEFAULTS) -> Column:
    """Re-enrich when more than a fifth of the chunks are new; otherwise only refresh the signature."""
    return F.when(new_count > 0, added_count / new_count > settings.reenrich_added_fraction).otherwise(F.lit(False))


def dirty_nodes(nodes: DataFrame, changed: DataFrame, key: str = "document_id") -> DataFrame:
    """Tree nodes above any changed chunk: ``(key, node_id)``.

    ``nodes`` has ``node_id`` and ``children``; ``changed`` has ``chunk_id``. One join per tree level on edges
    written once, until a level finds no node that is new (so a cycle ends too).
    """
    edges = cut_lineage(nodes.select(key, F.explode("children").alias("child"), F.col("node_id").alias("parent")))
    frontier = changed.select(key, F.col("chunk_id").alias("child")).distinct()
    found = None
    while True:
        parents = edges.join(frontier, [key, "child"], "left_semi").select(key, F.col("parent").alias("child")).distinct()
        if found is not None:
            parents = parents.join(found, [key, "child"], "left_anti")
        frontier = cut_lineage(parents)
        found = frontier if found is None else found.unionByName(frontier)
        if frontier.isEmpty():
            return found.select(key, F.col("child").alias("node_id"))


def next_version_numbers(uploads: DataFrame, key: str, order: str, block: Column) -> DataFrame:
    """Number uploads 1, 2, ... inside each document by arrival."""
    return running_number(uploads, [key], block, [F.col(order)], "version_no")


def previous_versions(versions: DataFrame, key: str = "document_id", values: list[str] | None = None) -> DataFrame:
    """Attach the version before each one (the largest smaller number)."""
    values = values if values is not None else ["chunk_manifest"]
    block = F.floor(F.col("version_no") / VERSION_BLOCK)
    return previous_value(versions, [key], "version_no", block, values)


def current_versions(documents: DataFrame, versions: DataFrame, key: str = "document_id") -> DataFrame:
    """Each document's current version, or its highest one when the pointer leads nowhere."""
    body = F.struct(*[c for c in versions.columns if c != key])
    latest = versions.groupBy(key).agg(F.max_by(body, F.col("version_no")).alias("_latest"))
    pointed = versions.select(key, F.col("version_id").alias("current_version_id"), body.alias("_pointed"))
    joined = documents.join(pointed, [key, "current_version_id"], "left").join(latest, key, "left")
    chosen = F.coalesce("_pointed", "_latest")
    return joined.where(chosen.isNotNull()).select(key, *[chosen[c].alias(c) for c in versions.columns if c != key])


def manifest_chunks(versions: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks of each version in manifest order; ids without a chunk are skipped."""
    wanted = versions.select(key, F.posexplode("chunk_manifest").alias("position", "chunk_id"))
    return wanted.join(chunks.drop("ord"), [key, "chunk_id"])


def delta_chunks(new_chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """New chunks with the vectors already known for their ids; the rest stay null for embedding."""
    known = stored.where(F.col("embedding").isNotNull()).select("chunk_id", "embedding").dropDuplicates(["chunk_id"])
    return new_chunks.drop("embedding").join(known, "chunk_id", "left")
