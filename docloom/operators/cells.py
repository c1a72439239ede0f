"""Exact vector search and threshold joins in cells around pivots, pruned by the triangle inequality.

Vectors are unit vectors, so cosine s and distance d = sqrt(2 - 2 s) say the same. Each vector belongs to its nearest
pivot; a cell knows the largest distance from its pivot to a member, its radius. A point at distance d from the pivot is at least
d - radius away from every member, so cells farther off than the distance that is asked for are never read.

Pivots are chosen by hash, a bounded number of them, and shipped to tasks; which pivots are chosen changes the work and
never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.skew import top_per_key
from docloom.functions.vectors import dot, unit
from docloom.operators.topk import ROUND, TIE
from docloom.session import cut_lineage
from docloom.settings import DEFAULTS, Settings

PIVOTS = 256  # cells at most; their vectors are sent to every task
SLACK = 1e-6  # of a bound, for sums taken in another order
PROBED = 4  # cells of each query that set the first bar


def _rows(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as a matrix; shorter ones than width are filled up with zeros, which changes no distance."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    width = width or int(sizes.max(initial=1))
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (vectors @ pivots.T)))


def choose_pivots(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Distinct unit vectors of the rows with the smallest hashes; ``vectors`` has ``id`` and ``unit``."""
    rows = vectors.select("unit").groupBy(F.xxhash64("unit").alias("h")).agg(F.first("unit").alias("unit")).orderBy("h").limit(count).collect()
    return _rows(pa.array([r.unit for r in rows], pa.list_(pa.float64()))) if rows else np.zeros((0, 1))


def _assigned(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        far = distances(_rows(batch.column("unit"), pivots.shape[1]), pivots)
        cell = far.argmin(1) if len(far) else np.zeros(0, np.int64)
        names = [*batch.schema.names, "cell", "off"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], names=names)


def assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` with ``cell`` (the nearest pivot) and ``off`` (the distance to it)."""
    columns = ", ".join(f"`{name}` {kind}" for name, kind in vectors.dtypes)
    return vectors.mapInArrow(partial(_assigned, pivots=pivots), f"{columns}, cell int, off double")


def units(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows with ``unit``; null, empty and zero vectors have no direction and are left out."""
    known = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.exists(vector, lambda x: x != 0))
    return known.withColumn("unit", unit(F.col(vector)))


def build(vectors: DataFrame, folder: str, pivots: int = PIVOTS) -> None:
    """Write vectors (``id``, ``vector`` of one length, and other columns) by cell, with a table of pivots, radii and sizes."""
    known = cut_lineage(units(vectors, "vector").drop("vector"))
    chosen = choose_pivots(known, pivots)
    assign(known, chosen).repartition("cell").write.partitionBy("cell").parquet(f"{folder}/members")
    members = known.sparkSession.read.parquet(f"{folder}/members")
    radii = members.groupBy("cell").agg(F.max("off").alias("radius"), F.count("*").alias("n"))
    table = known.sparkSession.createDataFrame([(i, row.tolist()) for i, row in enumerate(chosen)], "cell int, pivot array<double>")
    table.join(radii, "cell").coalesce(1).write.parquet(f"{folder}/cells")


def _cells_near(batches: Iterator[pa.RecordBatch], cells: pa.Table) -> Iterator[pa.RecordBatch]:
    """(query, cell, bound, turn) for every query and cell: the least distance to a member, and the place of the cell by it."""
    pivots, radius, names = _rows(cells.column("pivot")), cells.column("radius").to_numpy(), cells.column("cell").to_numpy()
    for batch in batches:
        bound = np.maximum(0.0, distances(_rows(batch.column("unit"), pivots.shape[1]), pivots) - radius)
        order = np.argsort(bound, axis=1, kind="stable")
        count = bound.shape[1]
        ids = batch.column("query_id").take(pa.array(np.repeat(np.arange(len(batch)), count)))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(count)[None, :], 1)
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(names, len(batch)).astype(np.int32)), pa.array(bound.ravel()), pa.array(place.ravel().astype(np.int32))], names=["query_id", "cell", "bound", "turn"])


def _within_cells(spark: SparkSession, folder: str, queries: DataFrame, pairs: DataFrame, visible: Column, k: int) -> DataFrame:
    """The k best members of the asked cells for each query and cell; only these cells' folders are read."""
    asked = [r.cell for r in pairs.select("cell").distinct().collect()]  # at most PIVOTS
    members = spark.read.parquet(f"{folder}/members").where(F.col("cell").isin(asked)).where(visible)
    wanted = pairs.select("query_id", "cell").join(queries.select("query_id", F.col("unit").alias("asked")), "query_id")
    id_type, query_type = members.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def score(found: pa.Table, some: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if found.num_rows and some.num_rows:
            scores = np.round(_rows(found.column("unit")) @ _rows(some.column("asked")).T, TIE)
            ids = np.asarray(found.column("id").to_pylist(), dtype=object)
            for column, query in enumerate(some.column("query_id").to_pylist()):
                at = np.argsort(-scores[:, column], kind="stable")
                if len(at) > k:
                    at = np.flatnonzero(scores[:, column] >= scores[at[k - 1], column])
                best = sorted(((-scores[i, column], ids[i]) for i in at))[:k]
                rows += [(query, i, -s) for s, i in best]
        schema = pa.schema([("query_id", some.schema.field("query_id").type), ("id", found.schema.field("id").type), ("score", pa.float64())])
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    # A cell may hold a third of all vectors: its members are dealt over slices, each of which meets the cell's queries.
    sizes = spark.read.parquet(f"{folder}/cells").select("cell", F.ceil(F.col("n") / DEFAULTS.grid_cell_rows).cast("int").alias("slices"))
    members = members.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    wanted = wanted.join(F.broadcast(sizes), "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    found = members.select("cell", "slice", "id", "unit").groupBy("cell", "slice").cogroup(wanted.select("cell", "slice", "query_id", "asked").groupBy("cell", "slice"))
    return found.applyInArrow(score, f"query_id {query_type}, id {id_type}, score double")


def nearest(spark: SparkSession, folder: str, queries: DataFrame, k: int, visible: Column | None = None, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """``(query_id, id, score, rank)`` of the k nearest visible members, exact, and ``(query_id, cells, read)``: how many cells there
    are and how many each query had to read.

    The nearest cells of a query set a bar, its k-th distance there; then all other cells whose bound is below the bar are
    read. ``queries`` is ``(query_id, vector)``. Ties go to the smaller id.
    """
    visible = F.lit(True) if visible is None else visible
    asked = cut_lineage(units(queries, "vector").select("query_id", "unit"))
    cells = spark.read.parquet(f"{folder}/cells").toArrow()  # at most PIVOTS rows
    query_type = asked.schema["query_id"].dataType.simpleString()
    pairs = cut_lineage(asked.mapInArrow(partial(_cells_near, cells=cells), f"query_id {query_type}, cell int, bound double, turn int"))
    first = cut_lineage(_within_cells(spark, folder, asked, pairs.where(F.col("turn") < PROBED), visible, k))
    order = [F.col("score").desc(), F.col("id")]
    bars = top_per_key(first, ["query_id"], order, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    bar = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))) + SLACK).otherwise(F.lit(3.0))
    more = pairs.where(F.col("turn") >= PROBED).join(bars.select("query_id", bar.alias("bar")), "query_id", "left").where(F.col("bound") <= F.coalesce("bar", F.lit(3.0)))
    more = cut_lineage(more.select("query_id", "cell"))
    second = _within_cells(spark, folder, asked, more, visible, k)
    best = top_per_key(first.unionByName(second), ["query_id"], order, k)
    read = pairs.groupBy("query_id").agg(F.count("*").alias("cells"), F.count_if(F.col("turn") < PROBED).alias("_first"))
    read = read.join(more.groupBy("query_id").agg(F.count("*").alias("_more")), "query_id", "left")
    return cut_lineage(best.withColumn("score", F.round("score", ROUND))), read.select("query_id", "cells", (F.col("_first") + F.coalesce("_more", F.lit(0))).alias("read"))


def _cells_within(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, radius: np.ndarray, reach: float) -> Iterator[pa.RecordBatch]:
    """One row for each row and cell that may hold a vector within reach of it."""
    for batch in batches:
        near, cell = np.nonzero(distances(_rows(batch.column("unit"), pivots.shape[1]), pivots) - radius <= reach + SLACK)
        taken = pa.array(near)
        yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns), pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """``(left_id, right_id, similarity)`` of all pairs whose cosine, rounded, reaches the threshold, and the candidate pairs that were compared.

    Both sides are ``(id, vector)`` and may have a ``scope``: rows meet only in an equal scope, and a null scope on the right
    meets every scope of the left; vectors of different lengths aren't alike. ``right`` is cut into cells; a row of ``left`` goes to the cells within reach of it
    only, and rows meet by cell and scope in an ordinary join.
    """
    scoped = lambda df: df if "scope" in df.columns else df.withColumn("scope", F.lit(None).cast("string"))
    one = units(scoped(left), "vector").select("id", "scope", "unit")
    two = cut_lineage(units(scoped(right), "vector").select("id", "scope", "unit"))
    longest = two.agg(F.max(F.size("unit"))).first()[0] or 1
    one = one.where(F.size("unit") <= longest)
    chosen = choose_pivots(two, pivots)
    nothing = one.sparkSession.createDataFrame([], f"left_id {dict(one.dtypes)['id']}, right_id {dict(two.dtypes)['id']}, similarity double")
    if not len(chosen):
        return nothing, nothing
    chosen = np.pad(chosen, ((0, 0), (0, longest - chosen.shape[1])))
    placed = cut_lineage(assign(two, chosen))
    off = placed.groupBy("cell").agg(F.max("off").alias("r")).collect()  # a row for each pivot
    radius = np.full(len(chosen), -3.0)
    for row in off:
        radius[row.cell] = row.r
    reach = float(np.sqrt(max(0.0, 2 - 2 * (threshold - 10.0**-ROUND))))
    columns = f"id {dict(one.dtypes)['id']}, scope string, unit array<double>, cell int"
    sent = one.withColumn("scope", F.col("scope").cast("string")).mapInArrow(partial(_cells_within, pivots=chosen, radius=radius, reach=reach), columns)
    # A row meets the rows of its own scope and those without one: two keys, so that both meet by equality.
    keyed = sent.withColumn("at", F.explode(F.array_distinct(F.array(F.coalesce(F.concat(F.lit("="), "scope"), F.lit("")), F.lit("")))))
    kept = placed.select(F.col("id").alias("right_id"), F.coalesce(F.concat(F.lit("="), F.col("scope").cast("string")), F.lit("")).alias("at"), "cell", F.col("unit").alias("other"))
    pairs = keyed.join(kept, ["cell", "at"]).where(F.size("unit") == F.size("other")).select(F.col("id").alias("left_id"), "right_id", F.round(dot(F.col("unit"), F.col("other")), ROUND).alias("similarity"))
    return pairs.where(F.col("similarity") >= threshold), pairs


__all__ = ["assign", "build", "choose_pivots", "nearest", "similar_pairs", "units"]
