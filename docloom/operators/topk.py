"""Exact top-k of many queries against a large table without materialising the pairs.

Each task scores its own rows against all queries as one matrix product and keeps k rows per
query; only those k are shuffled. Queries are shipped to every task while they fit a stated bound.
Beyond it the queries are cut into blocks and both sides meet in a grid of bounded cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.skew import top_per_key
from docloom.session import cut_lineage
from docloom.settings import DEFAULTS, Settings

Scorer = Callable[[pa.Table], np.ndarray]
TIE = 9  # places that scores are compared on, so that the order of a sum decides no rank
ROUND = 6  # places that are given back
QUERY_GROUP = 256  # queries weighed together
DENSE_CELLS = 4_000_000  # largest dense block a task builds


class _Best:
    """The k best (score, id) of every query seen so far in one task."""

    def __init__(self, queries: list[Any], k: int, floor: float | None) -> None:
        self.queries = queries
        self.k = k
        self.floor = floor
        self.kept: list[list[tuple[float, Any]]] = [[] for _ in queries]

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.round(scores, TIE)
        for column, kept in enumerate(self.kept):
            values = scores[:, column]
            candidates = np.flatnonzero(np.isfinite(values) if self.floor is None else values > self.floor)
            if len(candidates) > self.k:
                edge = -np.partition(-values[candidates], self.k - 1)[self.k - 1]
                candidates = candidates[values[candidates] >= edge]
            if len(kept) == self.k:
                candidates = candidates[values[candidates] >= kept[-1][0]]
            if len(candidates):
                kept.extend(zip(values[candidates].tolist(), ids[candidates].tolist()))
                kept.sort(key=lambda pair: (-pair[0], pair[1]))
                del kept[self.k:]

    def table(self, schema: pa.Schema) -> pa.RecordBatch:
        rows = [(q, i, s) for q, kept in zip(self.queries, self.kept) for s, i in kept]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _ids(table: pa.Table) -> np.ndarray:
    return np.asarray(table.column(0).to_pylist(), dtype=object)


def batch_topk(
    corpus: DataFrame,
    queries: DataFrame,
    prepare: Callable[[pa.Table], tuple[list[Any], Scorer]],
    k: int,
    floor: float | None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """``(query_id, id, score, rank)``: the k best corpus rows of each query.

    ``corpus`` has its id first; ``queries`` has its query id first. ``prepare`` turns a table of
    queries into their ids and a scorer ``corpus batch -> matrix[rows, queries]``. Rows whose score is
    not above ``floor`` never count. Ties go to the smaller id.
    """
    id_type = corpus.schema[0].dataType.simpleString()
    query_type = queries.schema[0].dataType.simpleString()
    output = f"query_id {query_type}, id {id_type}, score double"

    shipped = _collect_bounded(queries, settings)
    if shipped is not None:
        local = _local_topk(corpus, shipped, prepare, k, floor, output)
    else:
        local = _grid_topk(corpus, queries, prepare, k, floor, output, settings)
    # k rows per query, written once: callers read rankings several times and a lost executor must not cost a rescan.
    return cut_lineage(_merge(local, k).withColumn("score", F.round("score", ROUND)))


def _merge(local: DataFrame, k: int) -> DataFrame:
    """The best k of what all tasks kept, in two steps, so that no task receives the rows of every task for one query.

    Task n belongs to group floor(sqrt(n)): about sqrt(tasks) groups, each of at most twice as many tasks.
    """
    order = [F.col("score").desc(), F.col("id")]
    grouped = local.withColumn("_group", F.floor(F.sqrt(F.spark_partition_id())))
    return top_per_key(top_per_key(grouped, ["query_id", "_group"], order, k, "_n").drop("_n", "_group"), ["query_id"], order, k)


def _collect_bounded(queries: DataFrame, settings: Settings) -> pa.Table | None:
    """The query rows when they stay under both limits, else nothing."""
    limit = settings.broadcast_query_rows
    table = queries.limit(limit + 1).toArrow()
    if table.num_rows > limit or table.nbytes > settings.broadcast_query_bytes:
        return None
    return table


def arrow_schema(output: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(output))


def _local_topk(corpus, table, prepare, k, floor, output) -> DataFrame:
    schema = arrow_schema(output)
    shared = corpus.sparkSession.sparkContext.broadcast(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scorer = prepare(shared.value)
        best = _Best(names, k, floor)
        for batch in batches:
            part = pa.Table.from_batches([batch])
            step = max(1, DENSE_CELLS // max(1, len(names)))
            for low in range(0, part.num_rows, step):
                rows = part.slice(low, step)
                best.add(_ids(rows), scorer(rows))
        yield best.table(schema)

    return corpus.mapInArrow(score, output)


def _grid_topk(corpus, queries, prepare, k, floor, output, settings) -> DataFrame:
    """Block-by-block form: every (corpus cell, query block) pair is one bounded group."""
    schema = arrow_schema(output)
    query_id = queries.columns[0]
    distinct = queries.select(query_id).distinct().count()
    total = queries.count()
    per_query = max(1, -(-total // max(1, distinct)))
    blocks = max(1, -(-total // max(settings.broadcast_query_rows // 2, per_query)))
    cells = max(1, -(-corpus.count() // settings.grid_cell_rows))
    block_ids = F.sequence(F.lit(0), F.lit(blocks - 1))
    cell_ids = F.sequence(F.lit(0), F.lit(cells - 1))

    left = corpus.select(
        F.pmod(F.xxhash64(corpus.columns[0]), F.lit(cells)).cast("int").alias("_cell"), F.explode(block_ids).alias("_block"), "*"
    )
    right = queries.select(
        F.explode(cell_ids).alias("_cell"), F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int").alias("_block"), "*"
    )

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.Table.from_batches([], schema=schema)
        names, scorer = prepare(asked.drop_columns(["_cell", "_block"]))
        best = _Best(names, k, floor)
        rows = rows.drop_columns(["_cell", "_block"])
        step = max(1, DENSE_CELLS // max(1, len(names)))
        for low in range(0, rows.num_rows, step):
            part = rows.slice(low, step)
            best.add(_ids(part), scorer(part))
        return pa.Table.from_batches([best.table(schema)])

    return left.groupBy("_cell", "_block").cogroup(right.groupBy("_cell", "_block")).applyInArrow(score, output)


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row lengths and the flattened values of a list column."""
    joined = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(joined), 0).to_numpy(zero_copy_only=False)
    return lengths, joined.flatten()


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal-length list column as a 2-d float array."""
    lengths, values = _flat(column)
    data = values.to_numpy(zero_copy_only=False).astype(float)
    return data.reshape(len(lengths), int(lengths[0]) if len(lengths) else 0)


def _unit_rows(data: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(data, axis=1, keepdims=True)
    return data / np.where(lengths == 0, 1.0, lengths)


def cosine_queries(table: pa.Table) -> tuple[list[Any], Scorer]:
    """Queries as ``(query_id, vector)``; corpus batches as ``(id, vector)``."""
    asked = _unit_rows(matrix(table.column(1)))

    def scorer(part: pa.Table) -> np.ndarray:
        present = pc.is_valid(part.column(1)).to_numpy()
        scores = np.full((part.num_rows, len(asked)), -np.inf)
        if present.any():
            scores[present] = _unit_rows(matrix(part.column(1).filter(pa.array(present)))) @ asked.T
        return scores

    return table.column(0).to_pylist(), scorer


def bm25_queries(fields: int, k1: float, b: float) -> Callable[[pa.Table], tuple[list[Any], Scorer]]:
    """Queries as ``(query_id, field, term, weight, average_length)``; corpus as ``(id, terms of field 0, ...)``.

    ``weight`` already holds boost and inverse document frequency. A row scores the best of its fields.
    Queries are weighed in groups, so the weight matrix stays small however many queries there are.
    """

    def prepare(table: pa.Table) -> tuple[list[Any], Scorer]:
        names = sorted(set(table.column(0).to_pylist()))
        position = {name: i for i, name in enumerate(names)}
        query = np.array([position[q] for q in table.column(0).to_pylist()], dtype=np.int64)
        field = table.column(1).to_numpy()
        weight = table.column(3).to_numpy()
        average = table.column(4).to_numpy()
        plans = []
        for f in range(fields):
            for start in range(0, len(names), QUERY_GROUP):
                rows = np.flatnonzero((field == f) & (query >= start) & (query < start + QUERY_GROUP))
                if not len(rows):
                    continue
                terms = table.column(2).take(pa.array(rows))
                vocabulary = pc.unique(terms)
                slots = pc.index_in(terms, value_set=vocabulary).to_numpy()
                weights = np.zeros((len(vocabulary), min(QUERY_GROUP, len(names) - start)))
                np.add.at(weights, (slots, query[rows] - start), weight[rows])
                plans.append((f, start, vocabulary, weights, float(average[rows[0]])))

        def scorer(part: pa.Table) -> np.ndarray:
            best = np.zeros((part.num_rows, len(names)))
            flattened = {f: _flat(part.column(1 + f)) for f in {plan[0] for plan in plans}}
            for f, start, vocabulary, weights, average_length in plans:
                lengths, values = flattened[f]
                slots = pc.index_in(values, value_set=vocabulary)
                known = pc.is_valid(slots).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lengths)), lengths)[known]
                slot = pc.drop_null(slots).to_numpy(zero_copy_only=False)
                scale = k1 * (1 - b + b * lengths / average_length)
                width = len(vocabulary)
                step = max(1, DENSE_CELLS // width)
                for low in range(0, len(lengths), step):
                    high = min(low + step, len(lengths))
                    inside = slice(np.searchsorted(row, low), np.searchsorted(row, high))
                    cells = (row[inside] - low) * width + slot[inside]
                    counts = np.bincount(cells, minlength=(high - low) * width).reshape(high - low, width)
                    saturated = counts / (counts + scale[low:high, None])
                    columns = slice(start, start + weights.shape[1])
                    best[low:high, columns] = np.maximum(best[low:high, columns], saturated @ weights)
            return best

        return names, scorer

    return prepare


def count_cells(rows: DataFrame, terms: list[str], fields: int) -> DataFrame:
    """``(id, visible, lengths, cells, counts)`` from rows ``(id, visible, terms of field 0, ...)``: how long each field is and how often it holds each of ``terms``.

    A cell is field x number of terms + place of the term.
    """
    names = rows.columns[:2]
    output = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names) + ", lengths array<int>, cells array<int>, counts array<int>"
    schema = arrow_schema(output)
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(shared.value, pa.string())
        width = len(vocabulary)
        span = max(1, fields * width)
        for batch in batches:
            lengths = np.zeros((batch.num_rows, fields), dtype=np.int32)
            places = []
            for f in range(fields):
                lengths[:, f], values = _flat(batch.column(2 + f))
                slots = pc.index_in(values, value_set=vocabulary)
                known = pc.is_valid(slots).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows, dtype=np.int64), lengths[:, f])[known]
                places.append(row * span + f * width + pc.drop_null(slots).to_numpy(zero_copy_only=False))
            found, counts = np.unique(np.concatenate(places), return_counts=True)
            ends = np.searchsorted(found, np.arange(batch.num_rows + 1, dtype=np.int64) * span).astype(np.int32)
            arrays = [
                pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * fields), pa.array(lengths.ravel())),
                pa.ListArray.from_arrays(pa.array(ends), pa.array((found % span).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.int32))),
            ]
            kept = [batch.column(i).cast(schema.field(i).type) for i in range(2)]
            yield pa.RecordBatch.from_arrays(kept + [a.cast(schema.field(2 + i).type) for i, a in enumerate(arrays)], schema=schema)

    return rows.mapInArrow(count, output)


def bm25_cells(fields: int, width: int, k1: float, b: float) -> Callable[[pa.Table], tuple[list[Any], Scorer]]:
    """Queries as ``(query_id, field, cell, weight, average_length)``; corpus as ``(id, lengths, cells, counts)`` of `count_cells` over ``width`` terms.

    Scores like `bm25_queries`. A field that holds the same as the one before it under the same weights is not scored again.
    """

    def prepare(table: pa.Table) -> tuple[list[Any], Scorer]:
        names = sorted(set(table.column(0).to_pylist()))
        position = {name: i for i, name in enumerate(names)}
        query = np.array([position[q] for q in table.column(0).to_pylist()], dtype=np.int64)
        field = table.column(1).to_numpy()
        cell = table.column(2).to_numpy()
        weight = table.column(3).to_numpy()
        average = table.column(4).to_numpy()
        plans: dict[int, list[tuple]] = {f: [] for f in range(fields)}
        for f in range(fields):
            for start in range(0, len(names), QUERY_GROUP):
                rows = np.flatnonzero((field == f) & (query >= start) & (query < start + QUERY_GROUP))
                if not len(rows):
                    continue
                slots, inverse = np.unique(cell[rows] - f * width, return_inverse=True)
                weights = np.zeros((len(slots), min(QUERY_GROUP, len(names) - start)))
                np.add.at(weights, (inverse, query[rows] - start), weight[rows])
                column = np.full(width, -1, dtype=np.int64)
                column[slots] = np.arange(len(slots))
                plans[f].append((start, column, weights, float(average[rows[0]])))

        def alike(one: list[tuple], other: list[tuple]) -> bool:
            return len(one) == len(other) and all(x[0] == y[0] and x[3] == y[3] and np.array_equal(x[1], y[1]) and np.array_equal(x[2], y[2]) for x, y in zip(one, other))

        repeats = [f > 0 and alike(plans[f], plans[f - 1]) for f in range(fields)]

        def scorer(part: pa.Table) -> np.ndarray:
            best = np.zeros((part.num_rows, len(names)))
            lengths = _flat(part.column(1))[1].to_numpy(zero_copy_only=False).reshape(part.num_rows, fields)
            sizes, values = _flat(part.column(2))
            cells = values.to_numpy(zero_copy_only=False)
            counts = _flat(part.column(3))[1].to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(part.num_rows), sizes)
            owner = cells // width
            before: tuple[np.ndarray, ...] | None = None
            for f in range(fields):
                inside = owner == f
                held = (lengths[:, f], rows[inside], cells[inside] - f * width, counts[inside])
                if before is not None and repeats[f] and all(np.array_equal(x, y) for x, y in zip(held, before)):
                    continue
                before = held
                length, row, slot, count = held
                for start, column, weights, average_length in plans[f]:
                    scale = k1 * (1 - b + b * length / average_length)
                    place = column[slot]
                    step = max(1, DENSE_CELLS // len(weights))
                    for low in range(0, part.num_rows, step):
                        high = min(low + step, part.num_rows)
                        cut = slice(np.searchsorted(row, low), np.searchsorted(row, high))
                        asked = place[cut] >= 0
                        r, c, n = row[cut][asked], place[cut][asked], count[cut][asked]
                        saturated = np.zeros((high - low, len(weights)))
                        saturated[r - low, c] = n / (n + scale[r])
                        columns = slice(start, start + weights.shape[1])
                        best[low:high, columns] = np.maximum(best[low:high, columns], saturated @ weights)
            return best

        return names, scorer

    return prepare
