"""Language-model scoring by a weighted backoff automaton over the whole corpus.

States are histories of up to order - 1 tokens, the root is the empty one. State h has an arc for each token w
seen after it, weighted log p(w|h), and a failure arc to the history without its oldest token, weighted
log a(h). Counts are smoothed with a Dirichlet prior around the shorter history,

    p(w|h) = (c(hw) + m * p(w|h')) / (c(h) + m),    a(h) = m / (c(h) + m),

and the root uses the add-one estimate with one share for all unknown words, so each state's weights sum to one. A text is
traversed once from left to right: the state carried along is the longest history that was seen; where it has no arc for the
next token, the failure arc is paid and followed until a state has one; the arc's weight is added and its target carried on.

The model is never gathered anywhere. Slices of texts ask for the n-grams they contain, each once: keys are
hashes, a key's leading bits name the part that counts it. A part merges what all slices counted in training
texts and answers every asking slice with the counts in the order asked; there are as many parts as keep one near
PART_BYTES of text. The slices, read again, build the states and arcs that their texts can reach.
A slice is known by a hash of its content, so a changed reading is an error and never a silent mismatch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.columnar import binary, buffers, mix, slices, words_of
from docloom.llm.tables import at_least, register, table
from docloom.session import cut_lineage

FOLDS, HELD_OUT = 7, 2
ORDER = 3
PRIOR = 100.0  # m, in tokens
PART_BYTES = 32 << 20  # bytes of text for each part that counts n-grams
_END, _START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xA24BAED4963EE407)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_ids: list[int | None]) -> np.ndarray:
    """Whether crc32(doc_id as text) mod 7 is 2; a null id is an empty text."""
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % FOLDS == HELD_OUT for d in doc_ids], bool)


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


class Slice:
    """Tokens of some texts and their distinct n-grams, order by order, sorted by key."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, order: int):
        words = words_of(data, offsets)
        docs = len(offsets) - 1
        self.per_doc = words.per_doc() + 1
        self.ends = np.cumsum(self.per_doc) - 1
        self.firsts = self.ends - self.per_doc + 1
        tokens = np.empty(len(words.hash) + docs, np.uint64)
        tokens[np.arange(len(words.hash)) + words.doc] = words.hash
        tokens[self.ends] = _END
        self.doc = np.repeat(np.arange(docs), self.per_doc)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.samples: list[np.ndarray] = []  # where each distinct n-gram first stands
        past, key = tokens, tokens
        for _ in range(order):
            keys, sample, place = np.unique(key, return_index=True, return_inverse=True)
            self.levels.append((keys, place.reshape(-1)))
            self.samples.append(sample)
            past = np.concatenate([[_START], past[:-1]]) if len(past) else past
            past = past.copy()
            past[self.firsts] = _START
            key = mix(key * _STEP + past)

    def counts(self, training: np.ndarray) -> list[np.ndarray]:
        weight = training[self.doc].astype(np.float64)
        return [np.bincount(place.reshape(-1), weight, len(keys)).astype(np.uint64) for keys, place in self.levels]


def _cuts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that sorted keys belong to, by their leading 32 bits, and where each of them begins (and the last ends)."""
    part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    begins = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
    return part[begins], np.append(begins, len(keys))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[int | None], np.ndarray, np.ndarray]]:
    context, number = TaskContext.get(), 0
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        for first, last in slices(offsets):
            own = offsets[first : last + 1]
            part = np.ascontiguousarray(data[own[0] : own[-1]])
            name = xxhash.xxh3_128(part.tobytes())
            name.update(f"{context.partitionId() if context else 0} {number} {ids[first:last]} {np.diff(own).tolist()}".encode())
            number += 1
            yield name.digest(), ids[first:last], part, own - own[0]


def _ask(batches: Iterator[pa.RecordBatch], order: int, parts: int) -> Iterator[pa.RecordBatch]:
    for name, ids, data, offsets in _slices(batches):
        own = Slice(data, offsets, order)
        rows = []
        for level, ((keys, _), counts) in enumerate(zip(own.levels, own.counts(~held_out(ids)))):
            own_parts, cuts = _cuts(keys, parts)
            for p, a, b in zip(own_parts.tolist(), cuts, cuts[1:]):
                rows.append((p, level, name, pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(counts[a:b])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(binary([r[k] for r in rows]) for k in (2, 3, 4))],
            names=["part", "level", "slice", "keys", "counts"],
        )


def _answer(group: pa.Table) -> pa.Table:
    """Merged counts of one part, for each slice in the order in which it asked."""
    keys = [np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in group.column("keys")]
    counts = np.concatenate([unpack(x.as_py()) for x in group.column("counts")])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place.reshape(-1), counts.astype(np.float64), len(distinct)).astype(np.uint64)
    answers, ends = total[place.reshape(-1)], np.cumsum([len(k) for k in keys])
    tokens, known = int(total.sum()), int((total > 0).sum())
    rows = len(keys)
    return pa.table(
        {
            "part": group.column("part"), "level": group.column("level"), "slice": group.column("slice"),
            "counts": binary([pack(answers[e - len(k) : e]) for k, e in zip(keys, ends)]),
            "tokens": pa.array([tokens if i == 0 else 0 for i in range(rows)], pa.int64()), "types": pa.array([known if i == 0 else 0 for i in range(rows)], pa.int64()),
        }
    )


class Automaton:
    """States, arcs and failure arcs for the texts of a slice.

    State 0 is the root; then come, length by length, the distinct n-grams of the slice as histories and, last of each length, the
    history of starts alone. Arcs are numbered likewise by their n-grams; one whose n-gram was never seen has no target.
    """

    def __init__(self, own: Slice, counts: list[np.ndarray], tokens: int, types: int, starts: int, prior: float):
        order = len(own.levels)
        sizes = [len(keys) for keys, _ in own.levels]
        places = [place for _, place in own.levels]
        first = np.zeros(len(own.doc), bool)
        first[own.firsts] = True
        base = [0, *(1 + np.cumsum([0, *(n + 1 for n in sizes)])).tolist()]
        # States: depth, what is known of the history, and the failure arc.
        self.depth = np.zeros(base[order], np.int64)
        self.fail_to = np.zeros(base[order], np.int64)
        mass = np.zeros(base[order])
        for length in range(1, order):
            states = slice(base[length], base[length + 1])
            self.depth[states] = length
            mass[states] = np.append(counts[length - 1], starts)
            if length > 1:
                shorter = places[length - 2][own.samples[length - 1]]
                self.fail_to[states] = base[length - 1] + np.append(shorter, sizes[length - 2])
        self.fail_weight = np.log10(prior / (mass + prior))
        self.fail_weight[0] = 0.0
        self.start = base[order] - 1 if order > 1 else 0
        # Arcs: the state each leaves, its weight and its target; the root has one for every token.
        sources, targets, weights = [np.zeros(sizes[0], np.int64)], [], []
        p = (counts[0] + 1.0) / (tokens + types + 1)
        for level in range(order):
            sample, seen = own.samples[level], counts[level] > 0
            if level:
                before = places[level - 1][sample - 1]
                sources.append(base[level] + np.where(first[sample], sizes[level - 1], before))
                p = (counts[level] + prior * p[places[level - 1][sample]]) / (mass[sources[level]] + prior)
            if level < order - 1:
                target = base[level + 1] + np.arange(sizes[level])
            else:
                target = base[level] + places[level - 1][sample] if level else np.zeros(sizes[0], np.int64)
            targets.append(np.where(seen, target, -1 if level else 0))
            weights.append(np.log10(p))
        begins = np.cumsum([0, *sizes[:-1]])
        self.source, self.target, self.weight = np.concatenate(sources), np.concatenate(targets), np.concatenate(weights)
        self.arcs = [begin + place for begin, place in zip(begins, places)]  # by history length: the arc for the token at each position
        self.known = counts[0][places[0]] > 0

    def scores(self, own: Slice) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text: one traversal from left to right, carrying the state."""
        depth, fail_to, fail_weight, target, weight = (memoryview(x) for x in (self.depth, self.fail_to, self.fail_weight, self.target, self.weight))
        arcs = [memoryview(x) for x in self.arcs]
        out = []
        for begin, end in zip(own.firsts.tolist(), own.ends.tolist()):
            state, total = self.start, 0.0
            for at in range(begin, end + 1):
                arc = arcs[depth[state]][at]
                while (onward := target[arc]) < 0:
                    total += fail_weight[state]
                    state = fail_to[state]
                    arc = arcs[depth[state]][at]
                total += weight[arc]
                state = onward
            out.append(total)
        root = self.weight[self.arcs[0]]
        return own.per_doc, np.add.reduceat(self.known, own.firsts, dtype=np.int64), np.add.reduceat(root, own.firsts), np.array(out)


def walk(own: Slice, counts: list[np.ndarray], tokens: int, types: int, starts: int, prior: float) -> tuple[np.ndarray, ...]:
    """What Automaton.scores gives, by a closed form over all positions at once: its twin in tests."""
    per_level = [c[place.reshape(-1)].astype(np.float64) for c, (_, place) in zip(counts, own.levels)]
    root = np.log10((per_level[0] + 1) / (tokens + types + 1))
    arc, failed = np.power(10.0, root), np.zeros(len(root))
    weight = root
    for level in range(1, len(per_level)):
        # The history of a token at this level is the n-gram that ended at the token before it.
        history = np.empty(len(root))
        history[1:] = per_level[level - 1][:-1]
        history[own.firsts] = starts
        seen = per_level[level]
        arc = (seen + prior * arc) / (history + prior)
        has_arc = seen > 0
        failed = np.where(has_arc, 0.0, failed + np.log10(prior / (history + prior)))
        weight = np.where(has_arc, np.log10(arc), weight)
    score = weight + failed
    bounds = own.firsts
    return own.per_doc, np.add.reduceat(per_level[0] > 0, bounds, dtype=np.int64), np.add.reduceat(root, bounds), np.add.reduceat(score, bounds)


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for name, ids, data, offsets in _slices(batches):
        yield pa.RecordBatch.from_arrays([binary([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([offsets.tolist()], pa.list_(pa.int64())), binary([press.compress(data.tobytes())])], names=["slice", "ids", "offsets", "packed"])


def _score(batches: Iterator[pa.RecordBatch], order: int, tokens: int, types: int, starts: int, prior: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed, ids, offsets, answers in zip(batch.column("packed"), batch.column("ids"), batch.column("offsets"), batch.column("answers")):
            if not answers.is_valid:
                raise RuntimeError("the texts were read in another order the second time; write them to a table first")
            ids, offsets = ids.as_py(), np.array(offsets.as_py(), np.int64)
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed.as_py(), max_output_size=max(1, int(offsets[-1]))), np.uint8)
            own = Slice(data, offsets, order)
            answers = answers.as_py()
            counts = [np.concatenate([unpack(a["counts"]) for a in sorted((a for a in answers if a["level"] == level), key=lambda a: a["part"])]) for level in range(order)]
            length, known, base, score = Automaton(own, counts, tokens, types, starts, prior).scores(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held_out(ids)), pa.array(length, pa.int64()), pa.array(known), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def backoff_scores(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, parts: int | None = None) -> DataFrame:
    """One row for each text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are lower-cased (A-Z) words and one end; a null, empty or blank text is just its end. Texts whose
    crc32(doc_id as text) mod 7 is 2 are held out from training. Repeated rows count as often as they occur; other columns
    are ignored; an empty table gives no rows. docs has to be read alike twice: a scan of files is.
    """
    docs = at_least(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    starts, size = docs.agg(F.count_if(~held), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    asked = docs.mapInArrow(partial(_ask, order=order, parts=parts), "part int, level int, slice binary, keys binary, counts binary")
    answered = cut_lineage(asked.groupBy("part", "level").applyInArrow(_answer, "part int, level int, slice binary, counts binary, tokens bigint, types bigint"))
    known = answered.where("level = 0").agg(F.sum("tokens"), F.sum("types")).first()
    answers = answered.groupBy("slice").agg(F.collect_list(F.struct("part", "level", "counts")).alias("answers"))
    sent = docs.mapInArrow(_send, "slice binary, ids array<bigint>, offsets array<bigint>, packed binary")
    score = partial(_score, order=order, tokens=known[0] or 0, types=known[1] or 0, starts=starts, prior=prior)
    scored = sent.join(answers, "slice", "left").mapInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known[0] or 0).cast("bigint").alias("train_tokens"), "base_score", "score")


@register("op3_backoff_automaton")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return backoff_scores(table(spark, folder, "documents"))
