"""MinHash near-duplicate grouping with SuperMinHash signatures.

Each distinct shingle of a text draws a random permutation of the signature's places; its value for the place
that comes j-th is j plus a random fraction, and each place keeps its smallest value. The values of one shingle
are thereby ranks of one permutation, negatively correlated, which lowers the variance of the estimate.
Step j is taken by all shingles of all texts at once; a text stops as soon as its largest value is below
the next step's smallest possible one, for most texts after one or two steps.

Texts with the same set of shingles are one node. Nodes that agree in a band are candidates:

1. in each bucket every node is verified against the bucket's smallest node (rows in proportion to nodes);
2. verified links are joined into components by alternating star steps;
3. in a bucket whose other members still lie in several components, members outside the bucket's largest
   component are compared, in blocks, with all others; a cell of two blocks returns at most one link for each
   component that it joins.

So each pair that shares a bucket is compared or already in one component, no group is gathered in one task, and
pairs inside a group never become rows. Links are decided on the full sets: 100 * intersection >= threshold * union.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.columnar import SLICE_BYTES, binary, buffers, distinct, mix, shingles_of, signed, slices, words_of
from docloom.llm.tables import at_least, connected, register, row_key, table
from docloom.session import cut_lineage

BANDS, ROWS = 24, 5
BLOCK = 256  # members of a block when a bucket has to be compared in cells
_STEP_ROWS = 1 << 18  # shingles that draw whole permutations at once


def signatures(doc: np.ndarray, hashes: np.ndarray, docs: int, length: int) -> np.ndarray:
    """SuperMinHash values, docs x length, as (step << 32) + fraction; doc is sorted, hashes distinct per doc."""
    out = np.full((docs, length), np.uint64(0xFFFFFFFFFFFFFFFF))
    flat = out.reshape(-1)
    draw = mix(hashes + np.uint64(0x51ED270B27B4F3CF))
    np.minimum.at(flat, doc * length + (draw % np.uint64(length)).astype(np.int64), draw >> np.uint64(32))
    sizes = np.bincount(doc, minlength=docs)
    live = np.flatnonzero((out.max(1) >= np.uint64(1 << 32)) & (sizes > 0))
    ends = np.cumsum(sizes)
    for group in _groups(live, sizes):
        rows = np.concatenate([np.arange(ends[d] - sizes[d], ends[d]) for d in group])
        _later_steps(flat, doc[rows], draw[rows], length)
    return out


def _groups(live: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    group = np.cumsum(sizes[live]) // _STEP_ROWS
    for g in np.unique(group):
        yield live[group == g]


def _later_steps(flat: np.ndarray, doc: np.ndarray, draw: np.ndarray, length: int) -> None:
    """Steps 1, 2, ... for texts whose signature is not settled after step 0."""
    places = np.tile(np.arange(length, dtype=np.uint16), (len(doc), 1))
    index = np.arange(len(doc))
    first = (draw % np.uint64(length)).astype(np.int64)
    places[index, first], places[:, 0] = places[:, 0].copy(), first.astype(np.uint16)
    for step in range(1, length):
        draw = mix(draw + np.uint64(0x2545F4914F6CDD1D))
        swap = step + (draw % np.uint64(length - step)).astype(np.int64)
        chosen = places[index, swap]
        places[index, swap] = places[:, step]
        places[:, step] = chosen
        np.minimum.at(flat, doc * length + chosen.astype(np.int64), (draw >> np.uint64(32)) + np.uint64(step << 32))
        owners = np.unique(doc)
        open_ = owners[flat.reshape(-1, length)[owners].max(1) >= np.uint64((step + 1) << 32)]
        if not len(open_):
            return
        if len(open_) < len(owners):
            keep = np.isin(doc, open_)
            doc, draw, places, index = doc[keep], draw[keep], places[keep], np.arange(int(keep.sum()))


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), 1))
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    for k in range(rows):
        keys = mix(keys + parts[:, :, k])
    return keys


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch with their distinct shingles: first and last row, document, hash, and bounds per row."""
    data, offsets = buffers(batch.column("text"))
    for first, last in slices(offsets, SLICE_BYTES):
        own = offsets[first : last + 1]
        words = words_of(data[own[0] : own[-1]], own - own[0])
        doc, hashes = distinct(*shingles_of(words, shingle))
        yield first, last, doc, hashes, np.searchsorted(doc, np.arange(last - first + 1))


def _nodes(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    return [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) if b > a else None for a, b in zip(bounds[:-1], bounds[1:])]


def _sign(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, doc, hashes, bounds in _sets(batch, shingle):
            keys = signed(band_keys(signatures(doc, hashes, last - first, bands * rows), bands, rows)).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1, dtype=np.int32) * bands), pa.array(keys))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, last - first), batch.column("row").slice(first, last - first), pa.array(np.diff(bounds), pa.int64()), pa.array(_nodes(hashes, bounds), pa.binary()), lists],
                names=["doc_id", "row", "n_shingles", "node", "keys"],
            )


def _collect_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, _, hashes, bounds in _sets(batch, shingle):
            wanted = batch.column("node").slice(first, last - first).to_pylist()
            rows = [(n, hashes[a:b].tobytes()) for n, w, a, b in zip(_nodes(hashes, bounds), wanted, bounds[:-1], bounds[1:]) if n == w]
            yield pa.RecordBatch.from_arrays([binary([r[0] for r in rows]), binary([r[1] for r in rows])], names=["node", "items"])


def _links(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(two, one), len(two) - 1)
            shared = int((two[at] == one).sum())
            keep.append(100 * shared >= threshold * (len(one) + len(two) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def cell_links(items: list[np.ndarray], roots: list[bytes], threshold: int) -> list[tuple[bytes, bytes]]:
    """Links between different roots among these sets, at most one for each merge of two groups."""
    sizes = np.array([len(x) for x in items], np.float64)
    member = np.repeat(np.arange(len(items)), sizes.astype(np.int64))
    values, column, often = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    place = np.cumsum(often > 1) - 1
    shared = (often > 1)[column]
    member, column = member[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    inter = np.zeros((len(items), len(items)), np.float32)
    width = int(place[-1]) + 1 if len(values) else 0
    for low in range(0, width, 8192):
        a, b = np.searchsorted(column, [low, low + 8192])
        part = np.zeros((len(items), min(8192, width - low)), np.float32)
        part[member[a:b], column[a:b] - low] = 1
        inter += part @ part.T
    names, root = np.unique(np.array(roots, dtype=object), return_inverse=True)
    linked = (100 * inter.astype(np.float64) >= threshold * (sizes[:, None] + sizes[None, :] - inter)) & (root[:, None] < root[None, :])
    x, y = np.nonzero(linked)
    group, found = list(range(len(names))), []

    def top(n: int) -> int:
        while group[n] != n:
            group[n] = n = group[group[n]]
        return n

    for code in np.unique(root[x] * len(names) + root[y]):
        one, two = divmod(int(code), len(names))
        if top(one) != top(two):
            group[top(one)] = top(two)
            found.append((names[one], names[two]))
    return found


def _cells(threshold: int) -> Callable[[pa.Table], pa.Table]:
    def links(cell: pa.Table) -> pa.Table:
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell.column("items")]
        found = cell_links(items, cell.column("root").to_pylist(), threshold)
        return pa.table({"a": binary([a for a, _ in found]), "b": binary([b for _, b in found])})

    return links


def _residual_cells(exploded: DataFrame, buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(cell, node, root) of buckets whose members, the hub aside, lie in several components."""
    members = exploded.join(buckets.where("n > 2"), "key").where("node <> hub").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    members = cut_lineage(members)
    shares = members.groupBy("key", "root").count()
    main = shares.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots"), F.sum("count").alias("all"), F.max("count").alias("most")).where("roots > 1")
    same = members.join(main.select("key"), "key").groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    once = same.groupBy("n", "low", "high", "x", "y").agg(F.min("key").alias("key")).select("key")  # buckets of several bands with the same members
    rows = members.join(main.join(once, "key"), "key").withColumn("outer", F.col("root") != F.col("main"))
    outer_blocks = F.ceil((F.col("all") - F.col("most")) / F.lit(BLOCK)).cast("int")
    main_blocks = F.ceil(F.col("most") / F.lit(BLOCK)).cast("int")
    own = F.when(F.col("outer"), F.pmod(F.hash("node"), outer_blocks)).otherwise(F.pmod(F.hash("node"), main_blocks))
    rows = rows.withColumn("own", own)
    with_outer = F.transform(F.sequence(F.lit(0), outer_blocks - 1), lambda b: F.struct(F.lit("oo").alias("kind"), F.least("own", b).alias("i"), F.greatest("own", b).alias("j")))
    against_main = F.transform(F.sequence(F.lit(0), main_blocks - 1), lambda b: F.struct(F.lit("om").alias("kind"), F.col("own").alias("i"), b.alias("j")))
    from_main = F.transform(F.sequence(F.lit(0), outer_blocks - 1), lambda b: F.struct(F.lit("om").alias("kind"), b.alias("i"), F.col("own").alias("j")))
    cells = F.when(F.col("outer"), F.concat(with_outer, against_main)).otherwise(from_main)
    return rows.select("node", "root", "key", F.explode(cells).alias("cell"))


def _grouped(docs: DataFrame, shingle: int, threshold: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows (doc_id, row key, n_shingles, node), and (node, root, best) of their nodes; best orders the rows of a group."""
    docs = at_least(docs, ["doc_id", "text"]).withColumn("row", row_key())
    signed_ = cut_lineage(docs.mapInArrow(partial(_sign, shingle=shingle, bands=bands, rows=rows), "doc_id bigint, row binary, n_shingles bigint, node binary, keys array<bigint>"))
    known = signed_.where("node is not null")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nobody"), "doc_id", "row")).alias("best")
    nodes = known.groupBy("node").agg(best, F.first("keys").alias("keys"))
    exploded = cut_lineage(nodes.select("node", F.explode("keys").alias("key")))
    buckets = cut_lineage(exploded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    stars = cut_lineage(exploded.join(buckets, "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    asked = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = known.join(asked, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    fetched = docs.join(wanted, "row").select("node", "text")
    items = cut_lineage(fetched.mapInArrow(partial(_collect_sets, shingle=shingle), "node binary, items binary").dropDuplicates(["node"]))
    pairs = stars.join(items.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").join(items.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    links = cut_lineage(pairs.select("a", "b", "x", "y").mapInArrow(partial(_links, threshold=threshold), "a binary, b binary"))
    roots = cut_lineage(connected(links))
    cells = _residual_cells(exploded, buckets, roots).join(items, "node")
    more = cells.groupBy("key", "cell").applyInArrow(_cells(threshold), "a binary, b binary")
    roots = cut_lineage(connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
    return signed_, nodes.select("node", "best").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "best")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Near-duplicate groups of texts: doc_id, n_shingles, component_id, kept.

    Sets are distinct shingles of so many lower-cased (A-Z) words; a text with fewer words is one shingle.
    component_id is the smallest doc_id that links lead to. Null, empty and blank texts have no set and stand alone.
    Equal texts are linked whatever their ids; repeated rows of one doc_id are one document and get equal
    answers; a null doc_id never names a group that has another id. Other columns of docs are ignored. The bands
    miss a pair at the threshold with probability (1 - threshold^rows)^bands: the default ones below one in a million at 85 %, 7 in 100,000 at 80 %.
    """
    signed_, rooted = _grouped(docs, shingle, threshold, bands, rows)
    named = rooted.groupBy("root").agg(F.min("best").alias("best")).select("root", F.col("best.doc_id").alias("component_id"))
    of_node = rooted.select("node", "root").join(named, "root").select("node", "component_id")
    linked = signed_.where("node is not null").join(of_node, "node").select("doc_id", "n_shingles", "component_id")
    alone = signed_.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, shingle: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with exactly one row of each near-duplicate group, all columns: a row with the smallest doc_id (null: last).

    Rows are told apart by doc_id and text, so neither a shared nor a null doc_id ties one text to another; of rows with
    equal doc_id and text any one stays. Null, empty and blank texts belong to no group and all stay.
    """
    _, rooted = _grouped(docs, shingle, threshold, bands, rows)
    chosen = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("_row"))
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # Repeated rows are merged before the join, in part where they are read, so that none of them gathers in one task.
    once = docs.where(worded).withColumn("_row", row_key()).dropDuplicates(["_row"])
    return once.join(chosen, "_row", "left_semi").select(*docs.columns).unionByName(docs.where(~worded))


ORACLE = r"""
WITH RECURSIVE docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + {k} - 1], ' ') FOR i IN range(1, len(w) - {k} + 2)]) END AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= {t} * (len(p.s) + len(q.s) - n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, sets.doc_id = c AS kept
FROM sets JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1) USING (doc_id)
"""


@register("op4_superminhash", ORACLE.format(k=3, t=85))
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=3, threshold=85)
