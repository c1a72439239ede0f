"""Suffix-array removal of repeated byte strings, with a difference-cover sort in every bucket.

Which suffixes have to meet is settled first, without loss. Every string of ``length`` bytes chooses an anchor,
the 64-byte piece in it with the smallest hash (the leftmost such piece), so equal strings choose equal anchors
at equal places. Neighbouring strings that choose the same place form a run; runs with a common anchor form a bucket.

1. One scan makes the runs (about one for 170 bytes) and keeps anchor, run hash and place; runs whose anchor
   occurs once can't repeat and go.
2. Equal runs collapse: all their strings repeat, and one of them stands for all.
3. Buckets with several different runs fetch the bytes of one run of each kind. Inside a task, whole buckets are
   laid one after another and their suffixes are sorted by the difference cover {1, 2} modulo 3: sampled triples
   are sorted and named, names are recursed on until they differ, the remaining suffixes are sorted by
   first character and sampled rank, and both orders are merged. Neighbours in the suffix array that agree
   in their first ``length`` bytes are repeats. Candidates are picked by two fingerprints and confirmed byte by byte.
4. A bucket of very many different runs is not sorted in one task: its strings are counted by a 128-bit name
   with map-side aggregation, which needs no more than a row for each string.
5. Repeated strings go back to their texts by a hash of the text; covered bytes are removed there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.columnar import Prefix, binary, buffers, mix, signed, slices
from docloom.llm.tables import at_least, register, table
from docloom.session import cut_lineage

LENGTH = 400
PIECE = 64
SLICE_BYTES = 1 << 20  # bytes of text cut into runs at once; a longer text makes a slice of its own
SORT_BYTES = 1 << 19  # bytes of runs from which the buckets at hand are sorted
BUCKET_RUNS, BUCKET_BYTES = 8192, 1 << 20  # different runs of one anchor, and their bytes, that one task sorts at once; beyond, strings are counted by name
TASK_BYTES = 4 << 20  # bytes of runs dealt to a sorting task
TEXT = "doc_id bigint, text_key binary, packed binary, size bigint"


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with a common anchor place: document, anchor hash, run hash, start in the slice, strings."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    prefix = Prefix(data)
    at = np.arange(len(data) - piece + 1)
    hashes = prefix.of(at, at + piece)
    low = np.uint64((1 << max(1, len(data).bit_length())) - 1)
    chosen = (sliding_minimum((hashes & ~low) | at.astype(np.uint64), length - piece + 1) & low).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(len(chosen)), "right") - 1
    first = np.ones(len(chosen), bool)
    first[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(first)
    doc = doc[start]
    stop = np.minimum(np.append(start[1:], len(chosen)), offsets[doc + 1] - length + 1)  # strings stay in one text
    fits = stop > start
    start, stop, doc = start[fits], stop[fits], doc[fits]
    anchor = chosen[start]
    own = mix(prefix.of(start, stop + length - 1) + (anchor - start).astype(np.uint64))
    return doc, hashes[anchor], own, start, stop - start


def _runs(batches: Iterator[pa.RecordBatch], length: int, piece: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        ids = batch.column("doc_id")
        for first, last in slices(offsets, SLICE_BYTES):
            own = offsets[first : last + 1]
            part = data[own[0] : own[-1]]
            doc, anchor, run, start, count = runs_of(part, own - own[0], length, piece)
            keys = pa.array(_text_keys(part, own - own[0]), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(first + doc)), keys.take(pa.array(doc)), pa.array(signed(anchor)), pa.array(signed(run)), pa.array((start + own[0] - own[doc]).astype(np.int64)), pa.array(count.astype(np.int64))],
                names=["doc_id", "text_key", "anchor", "run", "start", "count"],
            )


def _text_keys(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    view = memoryview(np.ascontiguousarray(data))
    return [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle, with the hash of each."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        view = memoryview(np.ascontiguousarray(data))
        ends = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), binary(_text_keys(data, offsets)), binary([press.compress(view[a:b]) for a, b in ends]), pa.array(np.diff(offsets), pa.int64())],
            names=["doc_id", "text_key", "packed", "size"],
        )


def _cut_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked of each text."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        found = []
        for packed, size, asked in zip(batch.column("packed"), batch.column("size").to_pylist(), batch.column("asked").to_pylist()):
            text = open_.decompress(packed.as_py(), max_output_size=size)
            found += [(a["anchor"], a["run"], a["start"], text[a["start"] : a["start"] + a["count"] + length - 1]) for a in asked]
            if len(found) > 4096:
                yield _run_batch(batch, found)
                found = []
        yield _run_batch(batch, found)


def _run_batch(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([f[k] for f in found], pa.int64()) for k in range(2)), binary([f[3] for f in found])], names=["anchor", "run", "bytes"])


def _named(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of values among their distinct ones, and the number of those."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.zeros(len(values), np.int32)
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    np.cumsum(new, out=new)
    name = np.empty(len(values), np.int32)
    name[order] = new
    return name, int(new[-1]) + 1 if len(new) else 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start places of all suffixes of non-negative numbers in sorted order, by the difference cover {1, 2} modulo 3.

    Names and ranks have 32 bits (there are fewer than two billion suffixes), and only keys that are sorted have 64.
    """
    count = len(text)
    if count < 3:
        return np.array(sorted(range(count), key=lambda i: text[i:].tolist()), np.int64)
    padded = np.zeros(count + 4, np.int32)
    padded[:count] = (_named(text.astype(np.int64))[0] if text.max(initial=0) >= count else text) + np.int32(1)
    top = int(padded.max()) + 1
    # With count = 3k + 1 a dummy sample keeps the triple of the last real one apart from those of the other residue.
    sample = np.concatenate([np.arange(1, count + (count % 3 == 1), 3, dtype=np.int32), np.arange(2, count, 3, dtype=np.int32)])
    pairs = _named(padded[sample].astype(np.int64) * top + padded[sample + 1])[0]
    name, names = _named(pairs.astype(np.int64) * top + padded[sample + 2])
    del pairs
    order = np.argsort(name, kind="stable") if names == len(sample) else suffix_array(name)
    del name
    ordered = sample[order]
    del order, sample
    rank = np.zeros(count + 4, np.int32)
    rank[ordered] = np.arange(1, len(ordered) + 1, dtype=np.int32)
    wide = len(ordered) + 2
    ordered = ordered[ordered < count]
    rest = np.arange(0, count, 3, dtype=np.int32)
    rest = rest[np.argsort(padded[rest].astype(np.int64) * wide + rank[rest + 1], kind="stable")]
    # Merge: a remaining suffix meets sampled ones of residue 1 after one character, those of residue 2 after two.
    ones, twos = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    before = np.searchsorted(padded[ones].astype(np.int64) * wide + rank[ones + 1], padded[rest].astype(np.int64) * wide + rank[rest + 1])
    both = np.concatenate([twos, rest])
    heads = _named(padded[both].astype(np.int64) * top + padded[both + 1])[0].astype(np.int64) * wide + rank[both + 2]
    before += np.searchsorted(heads[: len(twos)], heads[len(twos) :])
    del heads, both, ones, twos, rank, padded
    out = np.empty(count, np.int64)
    place = before + np.arange(len(rest))
    taken = np.zeros(count, bool)
    taken[place] = True
    out[place] = rest
    out[~taken] = ordered
    return out


def repeated_starts(text: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Which valid places start a string of so many bytes that starts at another valid place too."""
    places = suffix_array(text)
    places = places[valid[places]]
    out = np.zeros(len(text), bool)
    if len(places) < 2:
        return out
    one, two = places[:-1], places[1:]
    prefix = Prefix(text)
    second = Prefix(mix(text.astype(np.uint64) + np.uint64(7)) & np.uint64(0xFFFF))
    alike = (prefix.of(one, one + length) == prefix.of(two, two + length)) & (second.of(one, one + length) == second.of(two, two + length))
    one, two = one[alike], two[alike]
    # Confirm: a pair that follows a confirmed pair byte for byte needs its last byte only, others all bytes.
    after = np.full(len(text) + 1, -1, np.int64)
    after[one] = two
    chained = (one > 0) & (after[one - 1] == two - 1) & (two > 0)
    same = text[one + length - 1] == text[two + length - 1]
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    heads = np.flatnonzero(~chained)
    for k in range(0, len(heads), 4096):
        part = heads[k : k + 4096]
        same[part] = (windows[one[part]] == windows[two[part]]).all(1)
    if not same.all():  # fingerprints deceived: compare all pairs in full
        for k in range(0, len(one), 4096):
            same[k : k + 4096] = (windows[one[k : k + 4096]] == windows[two[k : k + 4096]]).all(1)
    out[one[same]] = out[two[same]] = True
    return out


def _sort_buckets(batches: Iterator[pa.RecordBatch], length: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Repeated strings among the runs of whole buckets; rows come ordered by anchor."""
    anchors: list[int] = []
    runs: list[int] = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for anchor, run, text in zip(batch.column("anchor").to_pylist(), batch.column("run").to_pylist(), batch.column("bytes").to_pylist()):
            if anchors and anchor != anchors[-1] and held >= limit:
                yield _repeats(anchors, runs, texts, length)
                anchors, runs, texts, held = [], [], [], 0
            if not runs or (anchor, run) != (anchors[-1], runs[-1]):
                anchors.append(anchor)
                runs.append(run)
                texts.append(text)
                held += len(text)
    yield _repeats(anchors, runs, texts, length)


def _repeats(anchors: list[int], runs: list[int], texts: list[bytes], length: int) -> pa.RecordBatch:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    rows: list[tuple[int, int, int, int]] = []
    if texts:
        text = np.frombuffer(b"".join(texts), np.uint8)
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, ends - length + 1, -1)
        hit = repeated_starts(text, np.cumsum(edge[:-1]) > 0, length)
        turn = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        own = np.searchsorted(ends, first, "right")
        rows = [(anchors[o], runs[o], int(a - starts[o]), int(b - a)) for o, a, b in zip(own.tolist(), first, last)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["anchor", "run", "skip", "count"])


def _names(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A 128-bit name of each string of each run."""
    for batch in batches:
        for anchor, run, text in zip(batch.column("anchor").to_pylist(), batch.column("run").to_pylist(), batch.column("bytes")):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            at = np.arange(len(data) - length + 1)
            one = Prefix(data).of(at, at + length)
            two = Prefix(mix(data.astype(np.uint64) + np.uint64(7)) & np.uint64(0xFFFF)).of(at, at + length)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), anchor)), pa.array(np.full(len(at), run)), pa.array(at), pa.array(signed(one)), pa.array(signed(two))], names=["anchor", "run", "skip", "x", "y"])


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal covered stretches; stretches that touch are one."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), stops[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans(docs: DataFrame, length: int = LENGTH, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """text_key and spans (array of start, stop in bytes) of each different text with repeated strings."""
    piece = min(PIECE, length)
    docs = at_least(docs, ["doc_id", "text"])
    runs = cut_lineage(docs.mapInArrow(partial(_runs, length=length, piece=piece), "doc_id bigint, text_key binary, anchor bigint, run bigint, start bigint, count bigint"))
    # Written, so that the join deals out plain rows and an anchor with very many of them can be split.
    shared = cut_lineage(runs.groupBy("anchor").count().where("count > 1").select("anchor"))
    runs = cut_lineage(runs.join(shared, "anchor"))
    first = F.min(F.struct("doc_id", "text_key", "start", "count")).alias("first")
    kinds = cut_lineage(runs.groupBy("anchor", "run").agg(F.count("*").alias("n"), first))
    run_bytes = F.sum(F.col("first.count") + F.lit(length - 1)).alias("run_bytes")
    several = cut_lineage(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), run_bytes).where("kinds > 1"))
    asked = kinds.join(several, "anchor").select("first.doc_id", "first.text_key", F.struct("anchor", "run", "first.start", "first.count").alias("ask"))
    asked = asked.groupBy("doc_id", "text_key").agg(F.collect_list("ask").alias("asked"))
    texts = docs.mapInArrow(_packed, TEXT)
    same_text = texts["doc_id"].eqNullSafe(asked["doc_id"]) & (texts["text_key"] == asked["text_key"])
    fetched = texts.join(asked, same_text).select("packed", "size", "asked").mapInArrow(partial(_cut_runs, length=length), "anchor bigint, run bigint, bytes binary")
    fetched = cut_lineage(fetched.join(several, "anchor"))
    sorted_here = (F.col("kinds") <= bucket_runs) & (F.col("run_bytes") <= BUCKET_BYTES)
    # A number of its own, so that tasks of much sorting and few bytes aren't folded into a few.
    sorted_bytes = several.where(sorted_here).agg(F.sum("run_bytes")).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sorted_bytes // TASK_BYTES))
    few = fetched.where(sorted_here).select("anchor", "run", "bytes").repartition(tasks, "anchor").sortWithinPartitions("anchor", "run")
    found = few.mapInArrow(partial(_sort_buckets, length=length, limit=SORT_BYTES), "anchor bigint, run bigint, skip bigint, count bigint")
    many = fetched.where(~sorted_here).dropDuplicates(["anchor", "run"]).select("anchor", "run", "bytes")
    named = many.mapInArrow(partial(_names, length=length), "anchor bigint, run bigint, skip bigint, x bigint, y bigint")
    twice = named.groupBy("anchor", "x", "y").count().where("count > 1").select("anchor", "x", "y")
    found = found.unionByName(named.join(twice, ["anchor", "x", "y"]).select("anchor", "run", "skip", F.lit(1).cast("bigint").alias("count")))
    alone = kinds.where("n = 1").join(found, ["anchor", "run"]).select("first.text_key", (F.col("first.start") + F.col("skip")).alias("start"), found["count"])
    whole = runs.join(kinds.where("n > 1").select("anchor", "run"), ["anchor", "run"]).select("text_key", "start", "count")
    rows = alone.unionByName(whole).distinct().select("text_key", F.struct("start", (F.col("start") + F.col("count") + F.lit(length - 1)).alias("stop")).alias("span"))
    return rows.groupBy("text_key").agg(F.collect_list("span").alias("spans"))


def _strip(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for packed, size, found in zip(batch.column("packed"), batch.column("size").to_pylist(), batch.column("spans").to_pylist()):
            text = open_.decompress(packed.as_py(), max_output_size=size) if size else b""
            cuts = merged(np.array([s["start"] for s in found]), np.array([s["stop"] for s in found])) if found else []
            if as_text:
                cuts = [c for c in (_whole_characters(text, a, b) for a, b in cuts) if c[0] < c[1]]
            kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)]))
            rows.append((sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "stop": b} for a, b in cuts]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("size"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()),
                binary([r[3] for r in rows]), pa.array([r[4] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "cuts"],
        )


def _whole_characters(text: bytes, start: int, stop: int) -> tuple[int, int]:
    """The stretch without characters that it holds in part."""
    while start < stop and text[start] & 0xC0 == 0x80:
        start += 1
    while stop > start and stop < len(text) and text[stop] & 0xC0 == 0x80:
        stop -= 1
    return start, stop


def remove_repeats(docs: DataFrame, length: int = LENGTH, whole_characters: bool = False, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """One row for each text: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), cuts (start, stop).

    Removed is every byte covered by a string of ``length`` bytes that also starts anywhere else, judged on the input;
    texts are UTF-8 bytes, null is empty, and strings never cross texts. With whole_characters a cut leaves
    characters that it would split. Repeated rows and equal doc_ids are texts of their own, so the strings of a repeated row
    repeat; null doc_ids are kept. Texts shorter than ``length`` come back whole. Other columns are ignored.
    """
    texts = at_least(docs, ["doc_id", "text"]).mapInArrow(_packed, TEXT)
    joined = texts.join(spans(docs, length, bucket_runs), "text_key", "left").select("doc_id", "packed", "size", "spans")
    return joined.mapInArrow(
        partial(_strip, as_text=whole_characters),
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, cuts array<struct<start: bigint, stop: bigint>>",
    )


def _rewrite(batches: Iterator[pa.RecordBatch], columns: list[str], words: int) -> Iterator[pa.RecordBatch]:
    """Texts without the stretches of so many words found in them, and their length where it is a column."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        found, old = batch.column("spans").to_pylist(), batch.column("text")
        texts: list[str | None] = []
        for at, spans_ in enumerate(found):
            text = old[at].as_py()
            if spans_ and text is not None:
                raw = data[offsets[at] : offsets[at + 1]].tobytes()
                cuts = [_whole_characters(raw, a, b) for a, b in merged(np.array([s["start"] for s in spans_]), np.array([s["stop"] for s in spans_]))]
                cuts = [(a, b) for a, b in cuts if a < b and len(raw[a:b].split(maxsplit=words)) >= words]
                text = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(raw)])).decode()
            texts.append(text)
        changed = {"text": pa.array(texts, pa.string())}
        if "n_chars" in columns:
            changed["n_chars"] = pa.array([n if t is None or not s else len(t) for n, t, s in zip(batch.column("n_chars").to_pylist(), texts, found)], pa.int64())
        yield pa.RecordBatch.from_arrays([changed.get(c, batch.column(c)) for c in columns], names=columns)


def cut_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """docs with the repeated strings cut out of text (whole characters only) and n_chars following; all rows and columns stay.

    Of the maximal stretches covered by such strings only those of so many words go; words cut at their ends count.
    """
    keyed = docs.mapInArrow(_keyed, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", text_key binary")
    joined = keyed.join(spans(docs, length, bucket_runs), "text_key", "left")
    return joined.mapInArrow(partial(_rewrite, columns=docs.columns, words=words), docs.schema)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, binary(_text_keys(*buffers(batch.column("text"))))], names=[*batch.schema.names, "text_key"])


@register("op9_difference_cover")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
