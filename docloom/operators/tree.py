"""Summary trees: cluster a document's chunks, summarise each cluster, repeat up to a root.

Levels are built for all documents at once: one grouping per level, at most ``tree_max_depth`` of them.
Only the clustering of one document's vectors runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from docloom.functions.citations import numbered_sections
from docloom.functions.metadata import offline_summary
from docloom.functions.vectors import cosine, hash_embedder
from docloom.session import cut_lineage
from docloom.settings import DEFAULTS, Settings

Port = Callable[[Column], Column]
NODE_COLUMNS = ["document_id", "node_id", "level", "children", "summary_text", "embedding"]
CLUSTER_PROMPT = "Summarise these related passages in at most 120 words, keeping rules, amounts, dates and names.\n\n"
ROOT_PROMPT = "From these section summaries, describe the whole document in at most 150 words of plain prose.\n\n"
SINGLE_PROMPT = "Describe this document in at most 150 words of plain prose: purpose, key rules, dates.\n\n"
MAX_COMPONENTS = 10
FLOOR = 1e-5
LEAST_MASS = 10 * np.finfo(float).eps
SIGN = np.int64(-(2**63))
LEAST_LOG = -600.0  # of a weight: below any rounding, above the slow denormal numbers


def _principal(data: np.ndarray) -> np.ndarray:
    centred = data - data.mean(axis=0)
    keep = min(MAX_COMPONENTS, len(data) - 1, data.shape[1])
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    return u[:, :keep] * s[:keep]


def _seeds(data: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ centres; the first of them are those of every smaller k."""
    random = np.random.default_rng(seed)
    picks = [random.integers(len(data))]
    gap = ((data - data[picks[0]]) ** 2).sum(axis=1)
    while len(picks) < k:
        total = gap.sum()
        picks.append(random.choice(len(data), p=gap / total) if total > 0 else random.integers(len(data)))
        gap = np.minimum(gap, ((data - data[picks[-1]]) ** 2).sum(axis=1))
    return data[picks]


def _start(data: np.ndarray, sizes: range, seed: int) -> list[np.ndarray]:
    """Hard k-means labels for every k, all moved on together."""
    n, d = data.shape
    seeds = _seeds(data, sizes[-1], seed)
    centres = [seeds[:k] for k in sizes]
    labels: list[np.ndarray | None] = [None] * len(sizes)
    moving = list(range(len(sizes)))
    for _ in range(100):
        gaps = ((data - np.concatenate([centres[f] for f in moving])[:, None]) ** 2).sum(axis=2)
        changed, flat, at = [], [], 0
        for f in moving:
            nearest = gaps[at : at + sizes[f]].argmin(axis=0)
            if labels[f] is None or (nearest != labels[f]).any():
                flat.append(nearest + sum(sizes[g] for g in changed))
                labels[f] = nearest
                changed.append(f)
            at += sizes[f]
        moving = changed
        if not moving:
            break
        owner, slots = np.concatenate(flat), sum(sizes[f] for f in moving)
        count = np.bincount(owner, minlength=slots)[:, None]
        places = (owner[:, None] * d + np.arange(d)).ravel()
        sums = np.bincount(places, weights=np.tile(data, (len(moving), 1)).ravel(), minlength=slots * d).reshape(slots, d)
        moved = np.where(count > 0, sums / np.maximum(count, 1), np.concatenate([centres[f] for f in moving]))
        for f, part in zip(moving, np.split(moved, np.cumsum([sizes[f] for f in moving])[:-1])):
            centres[f] = part
    return labels


def _mixtures(data: np.ndarray, sizes: range, seed: int) -> list[tuple[float, np.ndarray]]:
    """(BIC, labels) of a diagonal Gaussian mixture for every k, fitted by expectation maximisation.

    The components of all fits are rows of the same matrices; a fit leaves them once it is done.
    """
    n, d = data.shape
    powers = np.vstack([data.T, data.T**2, np.ones(n)])
    fits, parts = np.arange(len(sizes)), np.array(sizes)
    first, owner = np.cumsum(parts) - parts, np.repeat(fits, parts)
    weight = np.concatenate([np.arange(k)[:, None] == label for k, label in zip(sizes, _start(data, sizes, seed))]).astype(float)
    before = np.full(len(sizes), -np.inf)
    found: list[tuple[float, np.ndarray]] = [(np.inf, np.zeros(n, int))] * len(sizes)
    for step in range(100):
        moments = powers @ weight.T
        mass = moments[-1] + LEAST_MASS
        moments /= mass
        means = moments[:d]
        spread = moments[d:-1] - means * means
        np.maximum(spread, 0, out=spread)
        spread += FLOOR
        # log density = first and second powers of the point times these, and what does not depend on the point
        factors = np.empty_like(moments)
        np.divide(means, spread, out=factors[:d])
        np.divide(-0.5, spread, out=factors[d:-1])
        volume = np.sqrt(np.multiply.reduce(spread, axis=0)) * (2 * np.pi) ** (d / 2)
        share = mass / np.add.reduceat(mass, first).take(owner)
        factors[-1] = np.log(share / volume) - 0.5 * np.add.reduce(means * factors[:d], axis=0)
        logs = factors.T @ powers
        top = np.maximum.reduceat(logs, first, axis=0)
        logs -= top.take(owner, axis=0)
        np.maximum(logs, LEAST_LOG, out=logs)
        weight = np.exp(logs, out=logs)
        sums = np.add.reduceat(weight, first, axis=0)
        weight /= sums.take(owner, axis=0)
        total = top + np.log(sums)
        level = np.add.reduce(total, axis=1) / n
        done = (np.abs(level - before) < 1e-3) | (step == 99)
        if done.any():
            for i in np.flatnonzero(done).tolist():
                k = int(parts[i])
                bic = -2 * total[i].sum() + (2 * k * d + k - 1) * np.log(n)
                found[fits[i]] = (bic, weight[first[i] : first[i] + k].argmax(axis=0))
            if done.all():
                break
            weight, parts, fits, level = weight[~done[owner]], parts[~done], fits[~done], level[~done]
            first, owner = np.cumsum(parts) - parts, np.repeat(np.arange(len(parts)), parts)
        before = level
    return found


def cluster(vectors: list, largest: int = DEFAULTS.tree_max_clusters, seed: int = 0) -> list[list[int]]:
    """Index groups by lowest BIC, ordered by their first member; three or fewer stay together."""
    count = len(vectors)
    if count <= 3:
        return [list(range(count))] if count else []
    data = _principal(np.array([np.asarray(v, dtype=float) for v in vectors]))
    upper = max(2, min(largest, count // 3 or 2, count - 1))
    labels = min(_mixtures(data, range(2, upper + 1), seed), key=lambda fit: fit[0])[1]
    groups: dict[int, list[int]] = {}
    for index, label in enumerate(labels.tolist()):
        groups.setdefault(label, []).append(index)
    return list(groups.values())


def _packed(vectors: list) -> list[bytes | None]:
    """Vectors as bytes that sort like the numbers; Spark copies them whole and not number by number."""
    rows = [None if v is None else np.asarray(v, dtype=float) for v in vectors]
    bits = (np.concatenate([r for r in rows if r is not None] or [np.empty(0)]) + 0.0).view(np.int64)
    flat = np.where(bits < 0, ~bits, bits ^ SIGN).astype(">i8").tobytes()
    ends = accumulate(0 if r is None else 8 * len(r) for r in rows)
    return [None if r is None else flat[end - 8 * len(r) : end] for r, end in zip(rows, ends)]


def _unpacked(packed: list) -> list[np.ndarray | None]:
    bits = np.frombuffer(b"".join(p for p in packed if p is not None), dtype=">i8").astype(np.int64)
    flat = np.where(bits < 0, bits ^ SIGN, ~bits).view(float)
    ends = accumulate(0 if p is None else len(p) // 8 for p in packed)
    return [None if p is None else flat[end - len(p) // 8 : end] for p, end in zip(packed, ends)]


@F.pandas_udf(BinaryType())
def pack_vectors(vectors: pd.Series) -> pd.Series:
    return pd.Series(_packed(vectors.tolist()), dtype=object)


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def cluster_groups(layers: pd.Series) -> pd.Series:
    return layers.map(lambda layer: cluster(_unpacked(layer)) if layer is not None else None)


def _layers(entries: DataFrame, position: str, name: str, text: str) -> DataFrame:
    """``(document_id, layer)``: what one level of a tree is built from, in order."""
    vector = pack_vectors(F.col("embedding").cast("array<double>"))
    entry = F.struct(F.col(position).alias("ord"), F.col(name).alias("id"), F.col(text).alias("text"), vector.alias("vector"))
    packed = entries.select("document_id", entry.alias("entry"))
    return packed.groupBy("document_id").agg(F.array_sort(F.collect_list("entry")).alias("layer"))


def node_id(document_id: Column, level: Column, children: Column) -> Column:
    digest = F.substring(F.sha1(F.array_join(children, "|").cast("binary")), 1, 12)
    return F.concat(document_id.cast("string"), F.lit(":r"), level.cast("string"), F.lit(":"), digest)


def _prompt(kind: Column, texts: Column, limit: int) -> Column:
    sections = numbered_sections(texts, limit)
    return (
        F.when(kind == "single", F.concat(F.lit(SINGLE_PROMPT), F.substring(F.array_join(texts, "\n\n"), 1, limit)))
        .when(kind == "root", F.concat(F.lit(ROOT_PROMPT), sections))
        .otherwise(F.concat(F.lit(CLUSTER_PROMPT), sections))
    )


def build_tree(
    chunks: DataFrame, summarize: Port = offline_summary, embed: Port | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Nodes of every document's tree from ``(document_id, chunk_id, ord, text, embedding)``."""
    embed = embed or hash_embedder(settings.embed_dim)
    layer = _layers(chunks, "ord", "chunk_id", "text")
    levels = []
    for level in range(1, settings.tree_max_depth + 1):
        last = level == settings.tree_max_depth
        count = F.size("ids")
        small = (count <= settings.tree_small_doc_chunks) if level == 1 else F.lit(False)
        vectors = F.transform("layer", lambda e: e["vector"])
        clustered = F.size("layer") > settings.tree_small_doc_chunks if level == 1 else F.lit(True)
        groups = F.lit(None).cast("array<array<int>>") if last else cluster_groups(F.when(clustered, vectors))
        # each group takes a copy of the ids and texts along; the vectors stay behind
        grouped = layer.select(
            "document_id", F.transform("layer", lambda e: e["id"]).alias("ids"), F.transform("layer", lambda e: e["text"]).alias("texts"), groups.alias("groups")
        )
        whole = F.array(F.sequence(F.lit(0), count - 1))
        final = F.lit(True) if last else (small | (F.size("groups") <= 1) | (F.size("groups") >= count))
        kind = F.when(final, F.when(small if not last or level == 1 else F.lit(False), "single").otherwise("root")).otherwise("cluster")
        # not a plain column of groups: Spark would ask for its size first, and cluster a second time for that
        rows = grouped.select(
            "document_id", kind.alias("kind"), "ids", "texts", F.posexplode(F.when(final, whole).otherwise(F.col("groups"))).alias("position", "members")
        )
        children = F.transform("members", lambda i: F.element_at("ids", i + 1))
        texts = F.transform("members", lambda i: F.element_at("texts", i + 1))
        summarized = rows.select(
            "document_id", "kind", "position", children.alias("children"),
            F.trim(summarize(_prompt(F.col("kind"), texts, settings.summary_input_chars))).alias("summary_text"),
        )
        nodes = cut_lineage(
            summarized.withColumn("level", F.lit(level))
            .withColumn("node_id", node_id(F.col("document_id"), F.col("level"), F.col("children")))
            .withColumn("embedding", embed(F.col("summary_text")))
        )
        levels.append(nodes.select(NODE_COLUMNS))
        layer = _layers(nodes.where("kind = 'cluster'"), "position", "node_id", "summary_text")
    tree = levels[0]
    for nodes in levels[1:]:
        tree = tree.unionByName(nodes)
    return tree


def roots(nodes: DataFrame) -> DataFrame:
    """The only node on a document's highest level; documents with several have none."""
    body = F.struct("level", "node_id", "summary_text")
    top = nodes.groupBy("document_id").agg(F.max("level").alias("top"))
    tops = nodes.join(top, "document_id").where(F.col("level") == F.col("top"))
    single = tops.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.first(body).alias("root")).where("n = 1")
    return single.select("document_id", "root.level", "root.node_id", "root.summary_text")


def nearest_nodes(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Level-one node with the highest cosine for each chunk, ties to the first node.

    A document has at most ``tree_max_clusters`` such nodes, which bounds the rows per chunk.
    """
    leaves = nodes.where("level = 1").select("document_id", "node_id", F.col("embedding").alias("node_vector"))
    scored = chunks.join(leaves, "document_id").withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("node_vector")), 9))
    best = scored.groupBy("document_id", "chunk_id").agg(F.min(F.struct((-F.col("similarity")).alias("rank"), "node_id")).alias("best"))
    return best.select("document_id", "chunk_id", "best.node_id", (-F.col("best.rank")).alias("similarity"))


def refresh_tree(
    nodes: DataFrame,
    chunks: DataFrame,
    dirty: DataFrame,
    added: DataFrame,
    removed: DataFrame,
    summarize: Port = offline_summary,
    embed: Port | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Trees after an edit, re-summarising only what the edit touches; adds ``refreshed`` to each node.

    Rebuilt from scratch instead: documents without a tree, small ones, and trees whose root is
    missing, ambiguous or directly above the chunks. ``dirty`` is ``(document_id, node_id)``; ``added`` and
    ``removed`` are ``(document_id, chunk_id)``.
    """
    embed = embed or hash_embedder(settings.embed_dim)
    depth = settings.tree_max_depth
    on = ["document_id"]

    # Prune: a removed chunk leaves its parent; an emptied parent leaves its own parent, level by level.
    edges = nodes.select("document_id", F.col("node_id").alias("parent"), "level", F.posexplode("children").alias("place", "child"))
    gone = removed.select("document_id", F.col("chunk_id").alias("child")).distinct()
    kept, lost = edges, None
    for _ in range(depth):
        hit = kept.join(gone, ["document_id", "child"], "left_semi").select("document_id", "parent").distinct()
        lost = hit if lost is None else lost.unionByName(hit)
        kept = kept.join(gone, ["document_id", "child"], "left_anti")
        gone = hit.join(kept.select("document_id", "parent").distinct(), ["document_id", "parent"], "left_anti").withColumnRenamed("parent", "child")
    alive = kept.select("document_id", F.col("parent").alias("node_id")).distinct()
    pruned = cut_lineage(nodes.join(alive, ["document_id", "node_id"], "left_semi"))

    sizes = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    steady = (
        roots(nodes).where("level > 1").select(on)
        .join(roots(pruned).select(on), on, "left_semi")
        .join(sizes.where(F.col("n") > settings.tree_small_doc_chunks), on, "left_semi")
    )
    rebuild = sizes.select(on).join(steady, on, "left_anti")
    no_leaves = added.select(on).distinct().join(pruned.where("level = 1").select(on).distinct(), on, "left_anti")
    rebuild = cut_lineage(rebuild.union(no_leaves.join(sizes, on, "left_semi")).distinct())
    rebuilt = build_tree(chunks.join(rebuild, on, "left_semi"), summarize, embed, settings).withColumn("refreshed", F.lit(True))

    # Attach each added chunk below its nearest level-one node.
    incoming = chunks.join(added.select("document_id", "chunk_id").distinct(), ["document_id", "chunk_id"], "left_semi")
    incoming = incoming.join(rebuild, on, "left_anti")
    attached = nearest_nodes(incoming.withColumn("embedding", F.coalesce("embedding", embed(F.col("text")))), pruned)
    new_edges = attached.select(
        "document_id", F.col("node_id").alias("parent"), F.lit(1).alias("level"), F.lit(2**31 - 1).alias("place"), F.col("chunk_id").alias("child")
    )
    fresh = new_edges.join(kept.select("document_id", "parent", "child"), ["document_id", "parent", "child"], "left_anti")
    edges = kept.join(rebuild, on, "left_anti").unionByName(fresh)
    order = chunks.select("document_id", F.col("chunk_id").alias("child"), F.col("ord"))
    placed = edges.join(order, ["document_id", "child"], "left").withColumn(
        "place", F.when(F.col("level") == 1, F.coalesce("ord", F.lit(0))).otherwise(F.col("place"))
    )
    children = cut_lineage(
        placed.groupBy("document_id", F.col("parent").alias("node_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "child"))), lambda c: c["child"]).alias("children"))
    )

    # Everything above a touched node is touched too.
    frontier = (
        dirty.select("document_id", "node_id").unionByName(lost.withColumnRenamed("parent", "node_id")).unionByName(attached.select("document_id", "node_id"))
    ).join(children.select("document_id", "node_id"), ["document_id", "node_id"], "left_semi").distinct()
    touched = frontier
    up = children.select("document_id", F.col("node_id").alias("above"), F.explode("children").alias("node_id"))
    for _ in range(depth - 1):
        frontier = up.join(frontier, ["document_id", "node_id"], "left_semi").select("document_id", F.col("above").alias("node_id")).distinct()
        touched = touched.unionByName(frontier)
    touched = cut_lineage(touched.distinct().withColumn("refreshed", F.lit(True)))

    current = pruned.drop("children").join(children, ["document_id", "node_id"]).join(touched, ["document_id", "node_id"], "left")
    current = current.withColumn("refreshed", F.coalesce("refreshed", F.lit(False)))
    top = roots(current).select("document_id", F.col("node_id").alias("root_id"))
    current = cut_lineage(current.join(top, on, "left"))

    texts = chunks.select("document_id", F.col("chunk_id").alias("child"), F.col("text").alias("child_text"))
    done = None
    for level in range(1, depth + 1):
        here = current.where(F.col("level") == level)
        stale = here.where("refreshed").select("document_id", "node_id", "root_id", F.posexplode("children").alias("place", "child"))
        gathered = stale.join(texts, ["document_id", "child"]).groupBy("document_id", "node_id", "root_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "child_text"))), lambda c: c["child_text"]).alias("texts")
        )
        kind = F.when(F.col("node_id") == F.col("root_id"), "root").otherwise("cluster")
        renewed = gathered.select(
            "document_id", "node_id", F.trim(summarize(_prompt(kind, F.col("texts"), settings.summary_input_chars))).alias("new_text")
        ).withColumn("new_vector", embed(F.col("new_text")))
        merged = here.join(renewed, ["document_id", "node_id"], "left").withColumns(
            {"summary_text": F.coalesce("new_text", "summary_text"), "embedding": F.coalesce("new_vector", "embedding")}
        )
        merged = cut_lineage(merged.select(*NODE_COLUMNS, "refreshed"))
        done = merged if done is None else done.unionByName(merged)
        texts = texts.unionByName(merged.select("document_id", F.col("node_id").alias("child"), F.col("summary_text").alias("child_text")))
    return done.unionByName(rebuilt.select(*NODE_COLUMNS, "refreshed"))
