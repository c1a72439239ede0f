"""Exact, near and semantic duplicates without comparing everything with everything.

Copies of one text collapse to a single representative before any comparison, however many there
are. Representatives meet in shared MinHash buckets; buckets with the same members are visited once,
and a large bucket is cut into blocks that meet pairwise, so every task stays small. Each block pair
returns only the best partner of each member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from docloom.functions.skew import attach_per_key, top_per_key
from docloom.functions.vectors import md5
from docloom.session import cut_lineage
from docloom.operators.topk import arrow_schema, matrix
from docloom.settings import DEFAULTS, Settings

PRIME = 2_147_483_647
BLOCK = 256  # shingles permuted together, so that the arrays stay in a core's cache


def permutation(i: int) -> tuple[int, int]:
    """Coefficients of the i-th hash permutation, from the first 32 bits of MD5 of ``a<i>`` and ``b<i>``."""

    def first_bits(label: str) -> int:
        return int(hashlib.md5(label.encode()).hexdigest()[:8], 16)

    return first_bits(f"a{i}") % (PRIME - 1) + 1, first_bits(f"b{i}") % PRIME


def minhash(permutations: int = DEFAULTS.minhash_perm, size: int = 5, with_copy: bool = False):
    """UDF from lower-cased text to the signature of its word shingles; null for a text without words.

    Words are parted here, at the blanks that `normalize` knows. With ``with_copy`` the outcome is ``(copy, signature)``, copy being the hash of the normalised text.
    """
    factors = np.array([permutation(i) for i in range(permutations)], dtype=np.uint64)
    a, b = factors[:, :1], factors[:, 1:]
    prime, shift = np.uint32(PRIME), np.uint64(31)

    def lowest(hashes: np.ndarray, wide: np.ndarray, folded: np.ndarray, rest: np.ndarray) -> np.ndarray:
        least = np.full(permutations, PRIME, dtype=np.uint32)
        for start in range(0, len(hashes), BLOCK):
            part = hashes[start : start + BLOCK]
            value, low, high = wide[:, : len(part)], folded[:, : len(part)], rest[:, : len(part)]
            np.multiply(a, part, out=value)
            value += b
            # The remainder by 2^31 - 1: upper and lower 31 bits added, less the prime where that does not wrap.
            low[...] = value
            low &= prime
            value >>= shift
            high[...] = value
            low += high
            np.subtract(low, prime, out=high)
            np.minimum(low, high, out=low)
            np.minimum(least, low.min(axis=1), out=least)
        return least.astype(np.int64)

    def one(text: str | None, *room: np.ndarray) -> tuple[str | None, np.ndarray | None]:
        tokens = (text or "").split()
        if not tokens:
            return None, None
        data = " ".join(tokens).encode()
        spaces = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
        starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(data)]
        grams = {data[start:end] for start, end in zip(starts, ends[min(size, len(tokens)) - 1 :])}
        digests = b"".join([md5(g).digest() for g in grams])
        copy = hashlib.sha256(data).hexdigest() if with_copy else None
        return copy, lowest(np.frombuffer(digests, dtype=">u4")[::4].astype(np.uint64) % np.uint64(PRIME), *room)

    def signed(texts: pd.Series) -> list[tuple[str | None, np.ndarray | None]]:
        room = [np.empty((permutations, BLOCK), dtype=t) for t in (np.uint64, np.uint32, np.uint32)]
        return [one(text, *room) for text in texts]

    if with_copy:

        @F.pandas_udf("copy string, signature array<bigint>")
        def signature(texts: pd.Series) -> pd.DataFrame:
            copies, signatures = zip(*signed(texts)) if len(texts) else ((), ())
            return pd.DataFrame({"copy": pd.Series(copies, dtype=object), "signature": pd.Series(signatures, dtype=object)})

    else:

        @F.pandas_udf(ArrayType(LongType()))
        def signature(texts: pd.Series) -> pd.Series:
            return pd.Series([s for _, s in signed(texts)], dtype=object)

    # Keeps the planner from evaluating it again inside later expressions.
    return signature.asNondeterministic()


def with_signatures(documents: DataFrame, text: str = "text", settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``signature``; documents without any word have none and can never match."""
    return documents.withColumn("signature", minhash(settings.minhash_perm)(F.lower(F.col(text))))


def bands(signature: Column, settings: Settings = DEFAULTS) -> Column:
    """Array of ``(band, bucket)``."""
    rows = settings.minhash_perm // settings.minhash_bands

    def bucket(band: Column) -> Column:
        values = F.slice(signature, band * rows + 1, F.lit(rows))
        return F.struct(band.alias("band"), F.substring(F.sha1(F.array_join(values.cast("array<string>"), ",").cast("binary")), 1, 16).alias("bucket"))

    return F.transform(F.sequence(F.lit(0), F.lit(settings.minhash_bands - 1)), bucket)


def band_rows(signed: DataFrame, key: str, settings: Settings = DEFAULTS) -> DataFrame:
    """``(key, band, bucket)``: what saving a document's signature writes."""
    rows = signed.select(key, F.explode(bands(F.col("signature"), settings)).alias("b")).select(key, "b.band", "b.bucket")
    return rows.where(F.col("bucket").isNotNull())


def signature_similarity(left: Column, right: Column) -> Column:
    """Share of equal positions; 0 for different or zero lengths."""
    equal = F.aggregate(F.zip_with(left, right, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, e: n + F.coalesce(e, F.lit(0)))
    comparable = (F.size(left) > 0) & (F.size(left) == F.size(right))
    return F.when(comparable, equal / F.size(left)).otherwise(F.lit(0.0))


def first_copies(documents: DataFrame, key: str, content: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """``(key, copy_key, first_id, second_id, copies)`` for documents whose content occurs more than once."""
    tagged = documents.select(key, content.alias("copy_key"))
    sizes = tagged.groupBy("copy_key").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id")).where("copies > 1")
    two = top_per_key(tagged, ["copy_key"], [F.col(key)], 2, "_n").where("_n = 2").select("copy_key", F.col(key).alias("second_id"))
    facts = sizes.join(two, "copy_key")
    return attach_per_key(tagged, facts, ["copy_key"], "copies", key, settings.hot_key_share)


def exact_duplicates(documents: DataFrame, key: str = "document_id", content: str = "text") -> DataFrame:
    """Later documents with the very same bytes as an earlier one: ``(key, duplicate_of)``."""
    copies = first_copies(documents, key, F.sha2(F.col(content).cast("binary"), 256))
    return copies.where(F.col(key) != F.col("first_id")).select(key, F.col("first_id").alias("duplicate_of"))


def _cell_members(units: DataFrame, settings: Settings) -> DataFrame:
    """Representatives spread over comparison cells ``(cell, low, high)`` of bounded size."""
    # Written once each, because counting, choosing and placing all read them.
    rows = cut_lineage(band_rows(units, "unit", settings))
    stats = cut_lineage(
        rows.groupBy("band", "bucket")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.sum(F.hash("unit").cast("decimal(20,0)")).alias("_sum"),
            F.bit_xor(F.xxhash64("unit")).alias("_xor"),
            F.bit_xor(F.xxhash64("unit", F.lit(1))).alias("_xor2"),
        )
        .where("members > 1")
    )
    # Buckets holding exactly the same members lead to the same comparisons: keep one of them.
    once = stats.groupBy("members", "_sum", "_xor", "_xor2").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.band", "b.bucket", F.lit(True).alias("_visit"))
    # Every shared bucket stays in the facts, visited or not, so that none of the large ones is shuffled by key alone.
    facts = cut_lineage(stats.select("band", "bucket", "members").join(once, ["band", "bucket"], "left"))
    members = attach_per_key(rows, facts, ["band", "bucket"], "members", "unit", settings.hot_key_share).where("_visit")
    blocks = F.ceil(F.col("members") / settings.dedup_block_rows).cast("int")
    own = F.pmod(F.xxhash64("unit"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("low"), F.greatest(own, j).alias("high")))
    placed = members.select("unit", "band", "bucket", own.alias("block"), F.explode(others).alias("c"))
    return placed.select("unit", F.concat_ws(":", "bucket", "band", "c.low", "c.high").alias("cell"), "block", "c.low", "c.high")


def _best_in_cells(threshold: float, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Best partner of each member by signature, and best one among those with a close vector.

    Rows arrive sorted by cell; only the rows of one batch and one unfinished cell are held.
    """

    def compare(ids: np.ndarray, block: np.ndarray, same: bool, signatures: np.ndarray, vectors: np.ndarray | None) -> Iterator[tuple]:
        for i in range(len(ids)):
            allowed = np.ones(len(ids), bool) if same else block != block[i]
            allowed[i] = False
            if not allowed.any():
                continue
            agreement = np.where(allowed, (signatures == signatures[i]).mean(axis=1), -1.0)
            best = int(agreement.argmax())
            close = None
            if vectors is not None:
                near = np.where(np.round(vectors @ vectors[i], 9) >= threshold, agreement, -1.0)
                close = int(near.argmax()) if near.max() > 0 else None
            found = (None, None) if close is None else (ids[close], float(near[close]))
            yield (ids[i], ids[best] if agreement[best] > 0 else None, float(agreement[best]), *found)

    def cells_of(part: pa.Table) -> Iterator[tuple]:
        ids = np.array(part.column("unit").to_pylist(), dtype=object)
        cell = part.column("cell").to_numpy()
        block = part.column("block").to_numpy()
        same = pc.equal(part.column("low"), part.column("high")).to_numpy()
        signatures = matrix(part.column("signature")).astype(np.int64)
        vectors = matrix(part.column("vector")) if part.column("vector").null_count == 0 else None
        edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
        for low, high in zip(edges[:-1], edges[1:]):
            yield from compare(ids[low:high], block[low:high], bool(same[low]), signatures[low:high], None if vectors is None else vectors[low:high])

    def emit(part: pa.Table) -> pa.RecordBatch:
        columns = list(zip(*cells_of(part))) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(cell, cell[-1]))  # where this batch's last cell starts
            starts_new = not held or held[-1].column("cell")[-1].as_py() != cell[-1]
            if cut or starts_new:
                done = held + [batch.slice(0, cut)]
                if sum(p.num_rows for p in done):
                    yield emit(pa.Table.from_batches(done))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield emit(pa.Table.from_batches(held))

    return run


def duplicate_tiers(
    documents: DataFrame, key: str = "document_id", text: str = "text", vector: str | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """``(key, duplicate_of, duplicate_tier, similarity)`` for near and semantic duplicates.

    Near: the best signature match, at least ``near_dup_jaccard``, ties to the earliest document.
    Semantic: otherwise, of the documents sharing a bucket the best signature match whose (unit
    length) vector has cosine ``semantic_dup_threshold`` or more.
    """
    key_type = documents.schema[key].dataType.simpleString()
    vector_column = F.col(vector).cast("array<double>") if vector else F.lit(None).cast("array<double>")
    # The only pass over the texts, without a shuffle; everything below works on keys, hashes and signatures.
    signed = documents.select(key, minhash(settings.minhash_perm, with_copy=True)(F.lower(F.col(text))).alias("s"), vector_column.alias("vector"))
    keyed = cut_lineage(signed.select(key, F.col("s.copy").alias("_copy"), F.col("s.signature").alias("signature"), "vector"))
    wordy = keyed.where(F.col("signature").isNotNull())
    firsts = wordy.groupBy("_copy").agg(F.min(key).alias(key))
    units = cut_lineage(wordy.join(firsts, ["_copy", key], "left_semi").select(F.col(key).alias("unit"), "_copy", "signature", "vector"))

    cells = _cell_members(units, settings).join(units.select("unit", "signature", "vector"), "unit")
    output = f"unit {key_type}, partner {key_type}, similarity double, close_partner {key_type}, close_similarity double"
    # Members of a cell follow each other in id order, so ties go to the earliest document.
    gathered = cells.repartition("cell").sortWithinPartitions("cell", "unit")
    compared = gathered.mapInArrow(_best_in_cells(settings.semantic_dup_threshold, arrow_schema(output)), output)

    def best(score: str, partner: str) -> Column:
        return F.max_by(F.struct(F.col(partner).alias("partner"), F.col(score).alias("score")), F.when(F.col(partner).isNotNull(), F.struct(F.col(score), _descending(partner, key_type))))

    partners = compared.groupBy("unit").agg(best("similarity", "partner").alias("near"), best("close_similarity", "close_partner").alias("close"))
    by_copy = units.select("unit", "_copy").join(partners, "unit").select(F.col("_copy").alias("copy_key"), "near", "close")

    everything = wordy.select(key, F.col("_copy").alias("copy_key"))
    copies = first_copies(everything, key, F.col("copy_key"), settings)
    # How many rows share a text decides whether its facts go by broadcast or by shuffle.
    sizes = everything.groupBy("copy_key").agg(F.count(F.lit(1)).alias("_rows"))
    facts = sizes.join(by_copy, "copy_key", "left").where("_rows > 1 OR near IS NOT NULL")
    matched = attach_per_key(everything, facts, ["copy_key"], "_rows", key, settings.hot_key_share, keep_unmatched=True)
    joined = matched.join(copies.select(key, "first_id", "second_id"), key, "left")
    twin = F.when(F.col("first_id") == F.col(key), F.col("second_id")).otherwise(F.col("first_id"))
    options = F.array_sort(
        F.filter(
            F.array(
                F.when(twin.isNotNull(), F.struct(F.lit(-1.0).alias("rank"), twin.alias("partner"))),
                F.when(F.col("near.partner").isNotNull(), F.struct((-F.col("near.score")).alias("rank"), F.col("near.partner").alias("partner"))),
            ),
            lambda o: o.isNotNull(),
        )
    )
    top = F.get(options, 0)
    near = F.when(-top["rank"] >= settings.near_dup_jaccard, F.struct(top["partner"].alias("of"), F.lit("near").alias("tier"), (-top["rank"]).alias("score")))
    close = F.when(F.col("close.partner").isNotNull(), F.struct(F.col("close.partner").alias("of"), F.lit("semantic").alias("tier"), F.col("close.score").alias("score")))
    return (
        joined.withColumn("d", F.coalesce(near, close))
        .where(F.col("d").isNotNull())
        .select(key, F.col("d.of").alias("duplicate_of"), F.col("d.tier").alias("duplicate_tier"), F.col("d.score").alias("similarity"))
    )


def _descending(column: str, key_type: str) -> Column:
    """A sort key under which the smaller id counts as larger, so ties go to the earliest document."""
    if key_type == "string":
        return F.translate(F.hex(F.col(column).cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210")
    return -F.col(column)
