"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item is contaminated into a document when at least threshold percent of its distinct shingles of five lower-cased
words occur in the document. Only shingles that some item has can matter, so each document is reduced
to those (a Bloom filter of fixed size, made in Spark, drops nearly all others; what it lets through costs time only). This
leaves what is contained in long documents as plain as in short ones. Equal reduced sets are searched once.

Sets are partitioned by size (powers of two). In a partition whose largest size is u, an item of q shingles that is
contained has Jaccard similarity of at least t / (u/q + 1 - t), and the number of rows per band is the
largest that still finds this similarity with a miss below one in a million. Where no banding gives that (u far above
q), the item is looked up by its q - ceil(t*q) + 1 smallest shingles, one of which must be there: exact, and just as
split by size. Candidates are verified on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.columnar import binary, buffers, distinct, mix, shingles_of, signed, slices, words_of
from docloom.llm.superminhash import signatures
from docloom.llm.tables import at_least, register, row_key, table
from docloom.session import cut_lineage

SHINGLE, THRESHOLD = 5, 80
LENGTH = 128  # signature values
ROWS = (8, 4, 2, 1)
MISS = 1e-6
FILTER_BITS = 23  # the filter takes 1 MB whatever the number of items


def _filter_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    low = np.uint64((1 << bits) - 1)
    return np.stack([(hashes >> np.uint64(k * 13)) & low for k in range(3)]).astype(np.int64)


def _shingles(data: np.ndarray, offsets: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the full size, and runs of those smaller sizes that whole short items have."""
    words = words_of(data, offsets)
    found = [shingles_of(words, SHINGLE)]
    for size in sizes:
        doc, hashes = shingles_of(words, size)
        full = words.per_doc()[doc] >= size
        found.append((doc[full], mix(hashes[full] + np.uint64(size))))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        words = words_of(data, offsets)
        per_doc = words.per_doc()
        doc, hashes = shingles_of(words, SHINGLE)
        for size in range(1, SHINGLE):  # a short item is one run of its own size
            at, own = shingles_of(words, size)
            exact = per_doc[at] == size
            hashes = hashes.copy()
            spot = np.flatnonzero(per_doc[doc] == size)
            order = np.argsort(doc[spot], kind="stable")
            hashes[spot[order]] = mix(own[exact] + np.uint64(size))
        doc, hashes = distinct(doc, hashes)
        bounds = np.searchsorted(doc, np.arange(len(offsets)))
        some = [i for i in range(len(offsets) - 1) if bounds[i + 1] > bounds[i]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id").take(pa.array(some, pa.int64())), pa.array([min(SHINGLE, int(per_doc[i])) for i in some], pa.int32()), pa.array([int(bounds[i + 1] - bounds[i]) for i in some], pa.int64()), binary([hashes[bounds[i] : bounds[i + 1]].tobytes() for i in some])],
            names=["item_id", "words", "n_item", "items"],
        )


def _bitmap(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    flags, column = np.zeros(1 << bits, bool), None
    for batch in batches:
        column = batch.schema.names[0]
        for value in batch.column(column):
            if column == "items":
                flags[_filter_places(np.frombuffer(value.as_buffer(), np.uint64), bits).reshape(-1)] = True
            else:
                flags |= np.unpackbits(np.frombuffer(value.as_buffer(), np.uint8)).astype(bool)
    if column:
        yield pa.RecordBatch.from_arrays([binary([np.packbits(flags).tobytes()])], names=["bitmap"])


def _reduced(batches: Iterator[pa.RecordBatch], bitmap: bytes, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Documents with shingles that pass the filter, and those shingles."""
    flags = np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool)
    bits = len(flags).bit_length() - 1
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for first, last in slices(offsets):
            own = offsets[first : last + 1]
            doc, hashes = _shingles(data[own[0] : own[-1]], own - own[0], sizes)
            hit = flags[_filter_places(hashes, bits)].all(0)
            doc, hashes = distinct(doc[hit], hashes[hit])
            some = np.unique(doc)
            low, high = np.searchsorted(doc, some), np.searchsorted(doc, some, "right")
            sets = [hashes[a:b].tobytes() for a, b in zip(low, high)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(first + some, pa.int64())), batch.column("row").take(pa.array(first + some, pa.int64())), binary([xxhash.xxh3_128_digest(s) for s in sets]), pa.array((high - low).astype(np.int64)), binary(sets)],
                names=["doc_id", "row", "node", "n", "items"],
            )


def rows_for(size: int, largest: int, threshold: int) -> int:
    """Rows per band for an item of this size among sets of up to that size; 0 where no banding is safe."""
    t = threshold / 100
    similarity = min(1.0, t / (largest / size + 1 - t))
    return next((r for r in ROWS if (1 - similarity**r) ** (LENGTH // r) <= MISS), 0)


def prefix_size(size: int, threshold: int) -> int:
    return size - -(-size * threshold // 100) + 1


def _keys(signature: np.ndarray, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), LENGTH // rows, rows)
    keys = np.tile(mix(np.arange(LENGTH // rows, dtype=np.uint64) + np.uint64(1000 * rows)), (len(signature), 1))
    for k in range(rows):
        keys = mix(keys + parts[:, :, k])
    return keys


def _sign(sets: list[np.ndarray]) -> np.ndarray:
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return signatures(doc, np.concatenate(sets) if sets else np.zeros(0, np.uint64), len(sets), LENGTH)


def _emit(rows: list[tuple], key: str) -> pa.RecordBatch:
    keys = [r[2] for r in rows]
    repeat = pa.array(np.repeat(np.arange(len(rows)), [len(k) for k in keys]), pa.int64())
    kinds = pa.int64() if key == "item_id" else pa.binary()
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], kinds).take(repeat), pa.array([r[1] for r in rows], pa.int32()).take(repeat), pa.array(signed(np.concatenate(keys)) if keys else [], pa.int64())], names=[key, "class", "key"]
    )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys under which a reduced set is found: its bands of all widths, and its shingles."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("items")]
        signature, rows = _sign(sets), []
        bands = [_keys(signature, r) for r in ROWS]
        for i, (node, own) in enumerate(zip(batch.column("node").to_pylist(), sets)):
            rows.append((node, len(own).bit_length(), np.concatenate([*(b[i] for b in bands), mix(own)])))
        yield _emit(rows, "node")


def _probe(batches: Iterator[pa.RecordBatch], classes: list[int], threshold: int) -> Iterator[pa.RecordBatch]:
    """Keys under which an item looks in each size class."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("items")]
        signature, rows = _sign(sets), []
        bands = {r: _keys(signature, r) for r in ROWS}
        for i, (item, own) in enumerate(zip(batch.column("item_id").to_pylist(), sets)):
            for c in classes:
                if (1 << c) - 1 >= -(-len(own) * threshold // 100):
                    r = rows_for(len(own), (1 << c) - 1, threshold)
                    rows.append((item, c, bands[r][i] if r else mix(own[: prefix_size(len(own), threshold)])))
        yield _emit(rows, "item_id")


def _verify(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [int(np.isin(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True).sum()) for x, y in zip(batch.column("x"), batch.column("y"))]
        out = pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("node"), batch.column("n_item"), pa.array(shared, pa.int64())], names=["item_id", "node", "n_item", "n_shared"])
        yield out.filter(pa.array([100 * s >= threshold * n for s, n in zip(shared, batch.column("n_item").to_pylist())], pa.bool_()))


def _matches(docs: DataFrame, benchmark: DataFrame, threshold: int, filter_bits: int) -> DataFrame:
    """doc_id, row key, item_id, n_item, n_shared of each test item that a row contains."""
    docs, benchmark = at_least(docs, ["doc_id", "text"]).withColumn("row", row_key()), at_least(benchmark, ["item_id", "text"])
    items = cut_lineage(benchmark.mapInArrow(_items, "item_id bigint, words int, n_item bigint, items binary"))
    sizes = sorted(r[0] for r in items.where(f"words < {SHINGLE}").select("words").distinct().collect())  # below five values
    maps = items.select("items").mapInArrow(partial(_bitmap, bits=filter_bits), "bitmap binary")
    bitmap = maps.repartition(16).mapInArrow(partial(_bitmap, bits=filter_bits), "bitmap binary").coalesce(1).mapInArrow(partial(_bitmap, bits=filter_bits), "bitmap binary").first()
    bitmap = bitmap[0] if bitmap else bytes((1 << filter_bits) // 8)
    reduced = cut_lineage(docs.mapInArrow(partial(_reduced, bitmap=bytes(bitmap), sizes=sizes), "doc_id bigint, row binary, node binary, n bigint, items binary"))
    nodes = cut_lineage(reduced.select("node", "items", "n").dropDuplicates(["node"]))
    largest = nodes.agg(F.max("n")).first()[0] or 0
    classes = list(range(1, int(math.log2(max(1, largest))) + 2))
    index = nodes.select("node", "items").mapInArrow(_index, "node binary, class int, key bigint")
    probe = items.select("item_id", "items").mapInArrow(partial(_probe, classes=classes, threshold=threshold), "item_id bigint, class int, key bigint")
    pairs = index.join(probe, ["class", "key"]).select("item_id", "node").distinct()
    own = items.select(F.col("item_id").alias("i"), "n_item", F.col("items").alias("x")).dropDuplicates(["i", "x"])
    full = pairs.join(own, F.col("item_id").eqNullSafe(F.col("i"))).join(nodes.select("node", F.col("items").alias("y")), "node").select("item_id", "node", "n_item", "x", "y")
    found = full.mapInArrow(partial(_verify, threshold=threshold), "item_id bigint, node binary, n_item bigint, n_shared bigint")
    return reduced.select("doc_id", "row", "node").join(found, "node").select("doc_id", "row", "item_id", "n_item", "n_shared")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of each test item that a document contains.

    Items of fewer than five words are one run of their words; null, empty and blank items and documents match nothing.
    Repeated documents or items give a row each; null ids stay null; other columns are ignored; an empty table on
    either side gives no rows.
    """
    found = _matches(docs, benchmark, threshold, filter_bits)
    return found.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs without the rows whose own text contains a test item, whatever other rows share their doc_id; all columns stay."""
    gone = _matches(docs, benchmark, threshold, filter_bits).select(F.col("row").alias("_row")).distinct()
    return docs.withColumn("_row", row_key()).join(gone, "_row", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
tests AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 5) AS k FROM tests WHERE len(w) > 0),
parts AS (SELECT DISTINCT item_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS x FROM sized),
sizes AS (SELECT DISTINCT k FROM sized),
grams AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS x FROM docs, sizes WHERE len(w) >= k),
counts AS (SELECT item_id, count(*) AS n_item FROM parts GROUP BY 1),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM grams JOIN parts USING (k, x) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM shared JOIN counts USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""


@register("op5_containment", ORACLE)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
