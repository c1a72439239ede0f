"""Vector compression by codebooks of parts, with a trie that shares distances.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts. Each part position has its own
codebook. Nearest entries are found for the distinct parts of many vectors at once: sorted parts are the leaves
of a lexicographic trie whose levels are the dimensions, and a depth-first walk over it carries, for each node, the squared
distances to all entries summed over the dimensions above. A node is summed once for all parts below it; leaves take the
least sum, and their weights (how many vectors have the part) go into the sums of the next codebook.

Nothing but sums leaves a task while codebooks are fitted: one row for each entry that has parts. The driver
holds the codebooks only. The last pass is a scan too, so vectors are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.skew import attach_per_key
from docloom.llm.tables import at_least, register, table
from docloom.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
HELD_BYTES = 16 << 20  # vectors of a task whose parts share one trie
WALK = 2048  # leaves of the trie walked at once


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return value.isNotNull() & F.coalesce(finite, F.lit(False))


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each vector, shorter ones filled up with zeros.

    Components are held within bounds that keep squared distances of whole vectors inside 64 bits.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bound = float(1 << ((60 - int(width).bit_length()) // 2))
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = np.clip(np.floor(flat * scale), -bound, bound).astype(np.int64)
    return out


def leaves(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct parts in lexicographic order, the leaf of each part, and how many parts each leaf has."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    new = np.ones(len(parts), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    leaf = np.empty(len(parts), np.int64)
    leaf[order] = np.cumsum(new) - 1
    return ordered[new], leaf, np.bincount(leaf)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties: the lower one) and its squared distance for distinct parts in lexicographic order.

    The order of the leaves is that of a depth-first walk. Leaves are taken some thousand at once; path keeps the summed
    distances of each node above the last leaf, so that a node that goes on into the next leaves isn't summed again.
    """
    count, width = parts.shape
    entry, distance = np.empty(count, np.int64), np.empty(count, np.int64)
    path = np.zeros((width + 1, len(book)), np.int64)
    for first in range(0, count, WALK):
        here = parts[first : first + WALK]
        parted = np.ones(here.shape, bool)
        parted[1:] = here[1:] != here[:-1]
        if first:
            parted[0] = here[0] != parts[first - 1]
        fork = parted.argmax(1)  # the first dimension in which a leaf leaves the path of the one before
        sums, node = path[:1], np.zeros(len(here), np.int64)
        for level in range(width):
            opens = np.flatnonzero(fork <= level)
            step = here[opens, level, None] - book[None, :, level]
            sums = np.concatenate([path[level + 1 : level + 2], sums[node[opens]] + step * step])
            node = np.cumsum(fork <= level)
            path[level + 1] = sums[-1]
        sums = sums[node]
        entry[first : first + WALK] = best = sums.argmin(1)
        distance[first : first + WALK] = sums[np.arange(len(here)), best]
    return entry, distance


def _held(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Rows of several batches together, up to a number of bytes."""
    rows: list[pa.RecordBatch] = []
    for batch in batches:
        rows.append(batch)
        if 8 * width * sum(len(b) for b in rows) >= HELD_BYTES:
            yield pa.Table.from_batches(rows)
            rows = []
    if rows:
        yield pa.Table.from_batches(rows)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    """Weighted sums of the parts of each entry, and their number as the last one."""
    places, entries, size = books.shape
    total = np.zeros((places, entries, size + 1), np.int64)
    for rows in _held(batches, places * size):
        vectors = integers(rows.column("vector"), places * size, scale)
        for place in range(places):
            parts, _, weight = leaves(vectors[:, place * size : (place + 1) * size])
            entry, _ = nearest(parts, books[place])
            np.add.at(total[place], entry, np.column_stack([parts, np.ones(len(parts), np.int64)]) * weight[:, None])
    place, entry = np.nonzero(total[:, :, -1])
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(entry), pa.array(list(total[place, entry]), pa.list_(pa.int64()))], names=["place", "entry", "sums"])


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    places, _, size = books.shape
    for rows in _held(batches, places * size):
        vectors = integers(rows.column("vector"), places * size, scale)
        codes, error = np.empty((len(vectors), places), np.uint8), np.zeros(len(vectors), np.int64)
        for place in range(places):
            parts, leaf, _ = leaves(vectors[:, place * size : (place + 1) * size])
            entry, distance = nearest(parts, books[place])
            codes[:, place] = entry[leaf]
            error += distance[leaf]
        text = codes.tobytes().hex()
        step = 2 * places
        done = pa.table({"vec_id": rows.column("vec_id"), "label": rows.column("label"), "code": [text[k : k + step] for k in range(0, len(text), step)], "error": error})
        yield from done.combine_chunks().to_batches()


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (part position, entry, dimension) of usable vectors (vec_id, vector), started from those with the smallest ids."""
    smallest = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not smallest:
        return np.zeros((parts, 0, 1), np.int64)
    size = max(1, -(-vectors.agg(F.max(F.size("vector"))).first()[0] // parts))
    start = integers(pa.array([r.vector for r in smallest], pa.list_(pa.float64())), parts * size, scale)
    books = np.ascontiguousarray(start.reshape(len(start), parts, size).transpose(1, 0, 2))
    for _ in range(rounds):
        found = vectors.select("vector").mapInArrow(partial(_sums, books=books, scale=scale), "place bigint, entry bigint, sums array<bigint>")
        columns = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(size + 1)]
        for row in found.groupBy("place", "entry").agg(*columns).collect():  # at most a row for each entry
            books[row.place, row.entry] = [int(row[2 + k]) // int(row[2 + size]) for k in range(size)]
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each usable vector, and the codebooks.

    vectors has vec_id, embedding and label; other columns are ignored. Rows whose vector is null or has a null, infinite or
    not-a-number component are left out. Rows with equal ids, null ids (they come last in the start of the codebooks)
    and repeated rows each get a row. A length that the parts don't divide, and vectors shorter than the longest one, are
    filled up with zeros. With fewer vectors than entries the codebooks are smaller. code has two hex digits for each part
    (so entries may be 256 at most), error is the squared distance to the entries. An empty table gives no rows.
    """
    known = at_least(vectors, ["vec_id", "embedding", "label"]).where(usable("embedding"))
    known = known.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")
    books = fit(known, parts, entries, rounds, scale)
    schema = f"vec_id {dict(known.dtypes)['vec_id']}, label {dict(known.dtypes)['label']}, code string, error bigint"
    if not books.size:
        return vectors.sparkSession.createDataFrame([], schema), books
    return known.mapInArrow(partial(_codes, books=books, scale=scale), schema), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over the rows with an equal label; null labels are one group."""
    named = cut_lineage(coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    per_label = cut_lineage(named.groupBy("_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error"), F.count("*").alias("_n")))
    return attach_per_key(named, per_label, ["_label"], "_n", "vec_id").drop("_label", "_n")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part position, entry and dimension."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


_ROUND = """
n{k} AS (SELECT vec_id, label, p, any_value(x.x) AS x, min({distance} * 64 + e) AS best FROM parts x JOIN b{k} b USING (p) GROUP BY vec_id, label, p),
f{k} AS (SELECT p, best % 64 AS e, i, sum(x[i]) AS s, count(*) AS n FROM n{k}, width, unnest(range(1, w + 1)) t(i) GROUP BY ALL),
g{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM f{k} GROUP BY ALL),
b{next} AS (SELECT p, e, coalesce(g{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN g{k} USING (p, e)),"""
_DISTANCE = "CAST(list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
ORACLE = (
    """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT CAST(max(len(v)) // 16 AS BIGINT) AS w FROM kept),
parts AS (SELECT vec_id, label, p, v[p * w + 1:(p + 1) * w] AS x FROM kept, width, range(16) t(p)),
b0 AS (SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 64),"""
    + "".join(_ROUND.format(k=k, next=k + 1, distance=_DISTANCE) for k in range(ROUNDS))
    + f"""
last AS (SELECT vec_id, label, p, min({_DISTANCE} * 64 + e) AS best FROM parts x JOIN b{ROUNDS} b USING (p) GROUP BY vec_id, label, p),
coded AS (SELECT vec_id, label, string_agg(lpad(to_hex(best % 64), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM last GROUP BY vec_id, label),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book
"""
)


@register("op13_trie_codes", ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = compress(table(spark, folder, "embeddings"))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
