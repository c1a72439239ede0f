"""Packing token sequences by non-negative least squares over the length histogram.

A document of n tokens gives n div W full windows and a remainder. Shallow combinations of remainder lengths that
fill a window exactly (all pairs, and triples of frequent lengths) are the columns of a matrix; non-negative
least squares gives how often to use each so that the histogram of remainders is met. Rounded down, these repeat
counts are the plan. Remainders of each length are numbered over the whole table, and the plan says of each (length, number)
in which window and where it lies, so that the windows do not depend on how rows are spread over tasks. Remainders that the plan
leaves over are packed greedily: they are laid end to end, longest first, and cut where a window is full; the last
window is cut at powers of two, which need no padding.

Only the histogram (at most W lengths) reaches the driver, and only the plan goes to the tasks (a few rows for each combination).
Texts are tokenised once. What is shuffled is a narrow row for each remainder, and the ids of remainders whose length is not used up by the plan.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.tables import at_least, register, table
from docloom.session import cut_lineage

WINDOW = 2048
CLOSE = 1  # id after each document
FREQUENT = 32  # lengths whose triples are enumerated
TASK_BITS = 40  # rows and windows of a task are numbered below the task's own number
VOCABULARY = "byte_bpe_50k"
ENCODED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sequence", pa.int64()), ("checks", pa.list_(pa.int64())), ("length", pa.int64()), ("task", pa.int64()),
     ("local", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
)
PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The public byte-level vocabulary; ranks and added tokens give the ids of the vocabulary's JSON form, several times faster.

    The added tokens stand in the JSON form only, beside the ranks; each one inside a text is one id.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    with open(f"{path.removesuffix('.tiktoken')}.json", encoding="utf-8") as form:
        added = {token["content"]: token["id"] for token in json.load(form)["added_tokens"]}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{VOCABULARY}.tiktoken")


def _encode(batches: Iterator[pa.RecordBatch], path: str, window: int) -> Iterator[pa.RecordBatch]:
    """Checksums of the full windows of each text, and its remainder with a number among those of equal length in this task."""
    encode = partial(tokenizer(path).encode, allowed_special="all")
    press = zstandard.ZstdCompressor(level=1)
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    row, sequence = task << TASK_BITS, (task + 1) << TASK_BITS
    seen: dict[int, int] = defaultdict(int)
    for batch in batches:
        made: list[tuple] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = np.array(encode(text.as_py() or "") + [CLOSE], np.uint16)
            full, length = divmod(len(ids), window)
            checks = [_checksum(ids[k * window : (k + 1) * window]) for k in range(full)]
            rest = ids[full * window :]
            made.append((row, doc, len(ids), sequence, checks, length, task, seen[length], _checksum(rest), press.compress(rest.tobytes())))
            seen[length] += 1
            row, sequence = row + 1, sequence + full
        yield pa.RecordBatch.from_pylist([dict(zip(ENCODED.names, values)) for values in made], schema=ENCODED)


def _checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def combinations(histogram: dict[int, int], window: int = WINDOW, frequent: int = FREQUENT) -> list[tuple[int, ...]]:
    """Combinations of two or three present lengths that fill a window exactly, longest part first."""
    found = {tuple(sorted((a, window - a), reverse=True)) for a in histogram if window - a in histogram}
    often = sorted(histogram, key=lambda a: (-histogram[a], a))[:frequent]
    found |= {tuple(sorted((a, b, window - a - b), reverse=True)) for a in often for b in often if window - a - b in histogram}
    return sorted(found, reverse=True)


def repeat_counts(histogram: dict[int, int], combos: list[tuple[int, ...]], sweeps: int = 200) -> np.ndarray:
    """Non-negative least squares by coordinate descent: how often to use each combination."""
    if not combos:
        return np.zeros(0)
    row = {a: i for i, a in enumerate(sorted(histogram))}
    matrix = np.zeros((len(row), len(combos)))
    for j, combo in enumerate(combos):
        for a in combo:
            matrix[row[a], j] += 1
    goal = np.array([histogram[a] for a in sorted(histogram)], np.float64)
    counts, rest, norms = np.zeros(len(combos)), goal.copy(), (matrix**2).sum(0)
    touched = [np.flatnonzero(matrix[:, j]) for j in range(len(combos))]
    parts = [matrix[t, j] for j, t in enumerate(touched)]
    for _ in range(sweeps):
        moved = 0.0
        for j, (t, part) in enumerate(zip(touched, parts)):
            step = max(-counts[j], float(part @ rest[t]) / norms[j])
            if step:
                counts[j] += step
                rest[t] -= part * step
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return counts


@dataclass(frozen=True)
class Plan:
    """Where the remainders of each length go, by their numbers."""

    #: length, first and last number, windows per number's turn (how often the length stands in the combination), first window, offset
    segments: list[tuple[int, int, int, int, int, int]]
    #: length, first number, position of that one in the greedy stream
    stream: list[tuple[int, int, int]]
    windows: int  # closed by the plan
    size: int  # tokens of the greedy stream

    def sequences(self, window: int) -> list[tuple[int, int]]:
        """(start, size) of the sequences that the last, partly filled window of the stream is cut into: powers of two."""
        at, left, out = self.size // window * window, self.size % window, []
        while left:
            out.append((at, 1 << (left.bit_length() - 1)))
            at, left = at + out[-1][1], left - out[-1][1]
        return out


def plan_of(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """Solve for repeat counts, round them down, and deal the numbers of each length to the windows; what is over makes the stream."""
    combos = combinations(histogram, window)
    counts = np.floor(repeat_counts(histogram, combos) + 1e-6).astype(int)
    used: dict[int, int] = defaultdict(int)
    segments, windows = [], 0
    for j in sorted(range(len(combos)), key=lambda j: (-counts[j], j)):
        shares = {a: combos[j].count(a) for a in combos[j]}
        times = min(int(counts[j]), *((histogram[a] - used[a]) // m for a, m in shares.items()))  # a solution of least squares may ask for more than there is
        if times < 1:
            continue
        offset = 0
        for a, m in shares.items():
            segments.append((a, used[a], used[a] + m * times, m, windows, offset))
            used[a] += m * times
            offset += a * m
        windows += times
    stream, size = [], 0
    for a in sorted(histogram, reverse=True):
        if used[a] < histogram[a]:
            stream.append((a, used[a], size))
            size += a * (histogram[a] - used[a])
    return Plan(segments, stream, windows, size)


def _cut(batches: Iterator[pa.RecordBatch], plan: Plan, window: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the remainders that lie in more than one sequence of the stream."""
    open_, tail = zstandard.ZstdDecompressor(), plan.sequences(window)
    for batch in batches:
        out: list[tuple] = []
        for doc, n, at, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "at", "ids"))):
            ids = np.frombuffer(open_.decompress(packed, max_output_size=2 * window), np.uint16)
            start = n - len(ids)
            while len(ids):
                sequence, first, size = at // window, at // window * window, window
                for k, (low, width) in enumerate(tail):
                    if at >= low:
                        sequence, first, size = plan.size // window + k, low, width
                piece = ids[: first + size - at]
                out.append((doc, start, len(piece), _checksum(piece), n, plan.windows + sequence, at - first))
                start, at, ids = start + len(piece), at + len(piece), ids[len(piece) :]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(len(PIECES))], names=PIECES)


def encoded(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """A row for each text (null: empty), closed by id 1: its token count, checksums of its full windows, and its remainder's ids."""
    schema = "row bigint, doc_id bigint, n bigint, sequence bigint, checks array<bigint>, length bigint, task bigint, local bigint, ids_crc32 bigint, ids binary"
    return at_least(docs, ["doc_id", "text"]).mapInArrow(partial(_encode, path=path or vocabulary_path(), window=window), schema)


def numbered(rows: DataFrame) -> DataFrame:
    """Number the remainders of each length over the whole table.

    A task has numbered its own ones; the counts of earlier tasks are added, so that a length that a third of the rows share is
    dealt over as many keys as there were tasks.
    """
    sizes = rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("own"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "task", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"))
    return rows.join(before, ["length", "task"]).withColumn("number", F.col("before") + F.col("local")).drop("before", "local", "task")


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Pieces of windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each row lies in one piece. Null, empty and blank texts are packed too (at least the closing id); repeated rows
    are packed as often as they occur, null ids stay null, other columns are ignored, and an empty table gives no pieces.
    """
    spark = docs.sparkSession
    rows = cut_lineage(encoded(docs, window, path))
    rests = rows.where("length > 0").select("row", "doc_id", "n", "length", "task", "local", "ids_crc32")
    plan = plan_of({r["length"]: r["count"] for r in rests.groupBy("length").count().collect()}, window)  # at most window - 1 lengths
    full = rows.select("doc_id", "n", "sequence", F.posexplode("checks").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"),
        (F.col("sequence") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    # At most three rows for each combination, and one for each length: bounded by the window.
    segments = [(*s, None) for s in plan.segments] + [(a, first, None, None, None, None, at) for a, first, at in plan.stream]
    segment = spark.createDataFrame(segments, "length bigint, first bigint, last bigint, share bigint, window bigint, shift bigint, stream bigint")
    turn = F.col("number") - F.col("first")
    inside = (F.col("number") >= F.col("first")) & (F.col("last").isNull() | (F.col("number") < F.col("last")))
    places = numbered(rests).join(F.broadcast(segment.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & inside)
    places = places.withColumn("at", F.col("stream") + turn * F.col("length"))
    places = places.withColumns({"head": _sequence(F.col("at"), plan, window), "end": _sequence(F.col("at") + F.col("length") - 1, plan, window)})
    planned, whole = F.col("at").isNull(), F.col("head.sequence") == F.col("end.sequence")
    places = cut_lineage(
        places.select(
            "row", "doc_id", "n", "length", "ids_crc32", "at", (planned | whole).alias("whole"),
            F.when(planned, F.col("window") + _div(turn, F.col("share"))).otherwise(F.col("head.sequence")).alias("sequence_id"),
            F.when(planned, F.col("shift") + turn % F.col("share") * F.col("length")).otherwise(F.col("at") - F.col("head.first")).alias("offset"),
        )
    )
    kept = places.where("whole").select("doc_id", (F.col("n") - F.col("length")).alias("start"), "length", "ids_crc32", F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    ids = rows.where(F.col("length").isin([a for a, _, _ in plan.stream])).select("row", "ids")
    parts = places.where("not whole").select("row", "doc_id", "n", "at").join(ids, "row").drop("row")
    return full.unionByName(kept).unionByName(parts.mapInArrow(partial(_cut, plan=plan, window=window), ", ".join(f"{c} bigint" for c in PIECES)))


def _div(a: Column, b: Column) -> Column:
    return ((a - a % b) / b).cast("long")


def _sequence(at: Column, plan: Plan, window: int) -> Column:
    """The sequence of a position of the stream, and where it begins."""
    spot = F.struct((_div(at, F.lit(window)) + plan.windows).alias("sequence"), (at - at % window).alias("first"))
    for k, (low, _) in enumerate(plan.sequences(window)):  # at most one for each bit of the window
        spot = F.when(at >= low, F.struct(F.lit(plan.windows + plan.size // window + k).cast("long").alias("sequence"), F.lit(low).cast("long").alias("first"))).otherwise(spot)
    return spot


@register("op6_nnls_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
