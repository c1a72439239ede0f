"""Everything a new version of a document sets off, for many documents at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.chunking import manifests
from docloom.operators.retrieval import fill_embeddings
from docloom.operators.tree import NODE_COLUMNS, refresh_tree, roots
from docloom.operators.versioning import delta_chunks, dirty_nodes, needs_enrichment, plan_delta
from docloom.session import cut_lineage
from docloom.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Delta:
    """Planned differences, chunks with vectors, refreshed trees, root summaries and counts, one row set each."""

    plans: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    summaries: DataFrame
    statistics: DataFrame


def apply_versions(previous: DataFrame, new_chunks: DataFrame, stored: DataFrame, nodes: DataFrame, settings: Settings = DEFAULTS) -> Delta:
    """Compare new versions with the previous manifests and redo only what changed.

    ``previous`` is ``(document_id, chunk_manifest)``. Vectors of chunks already ``stored`` are reused, the
    others embedded. Unchanged documents keep their tree; changed ones get it refreshed.
    """
    pairs = manifests(new_chunks).select("document_id", F.col("chunk_manifest").alias("new_manifest")).join(
        previous.select("document_id", F.col("chunk_manifest").alias("old_manifest")), "document_id", "left"
    )
    plans = cut_lineage(plan_delta(pairs))
    chunks = cut_lineage(fill_embeddings(delta_chunks(new_chunks, stored), dim=settings.embed_dim))

    has_tree = nodes.select("document_id").distinct()
    kept = plans.where("unchanged").join(has_tree, "document_id", "left_semi").select("document_id")
    moving = plans.join(kept, "document_id", "left_anti")
    added = moving.select("document_id", F.explode("added").alias("chunk_id"))
    removed = moving.select("document_id", F.explode("removed").alias("chunk_id"))
    old_nodes = nodes.join(moving.select("document_id"), "document_id", "left_semi")
    dirty = dirty_nodes(old_nodes, added.unionByName(removed))
    leaves = chunks.join(moving.select("document_id"), "document_id", "left_semi").select("document_id", "chunk_id", "ord", "text", "embedding")
    refreshed = refresh_tree(old_nodes.select(NODE_COLUMNS), leaves, dirty, added, removed, settings=settings)
    same = nodes.join(kept, "document_id", "left_semi").select(NODE_COLUMNS).withColumn("refreshed", F.lit(False))
    tree = cut_lineage(refreshed.unionByName(same))

    embedded = chunks.groupBy("document_id").agg(F.count_if("reembedded").alias("reembedded"))
    renewed = tree.groupBy("document_id").agg(F.count_if("refreshed").alias("nodes_refreshed"))
    counted = plans.select(
        "document_id", "new_root", F.size("added").alias("added"), F.size("removed").alias("removed"), F.size("reused").alias("reused"),
        needs_enrichment(F.size("added"), F.size("new_manifest"), settings).alias("reenrich"),
    )
    statistics = counted.join(embedded, "document_id", "left").join(renewed, "document_id", "left").fillna(0, ["reembedded", "nodes_refreshed"])
    summaries = roots(tree).select("document_id", F.col("summary_text").alias("root_summary"))
    return Delta(plans, chunks, tree, summaries, statistics)
