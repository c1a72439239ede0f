"""Quality rules by line labelling: a linear-chain conditional random field marks each line as content or boilerplate.

Lines with a word are the steps of the chain; each has a few yes/no features (length, symbols, capitals, repetition,
ending). The weights are trained by maximum likelihood on lines of a bounded sample of labelled documents, whose lines
count as content in good documents and as boilerplate in bad ones. The Viterbi path of a document gives its lines' labels,
and the share of its words in content lines decides. Features, counts and paths of all documents of a slice are computed
at once as arrays; the scan needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.columnar import Prefix, buffers, mix, slices, words_of
from docloom.llm.tables import at_least, register, table

SAMPLE = 3000  # labelled documents at most
CHUNK = 32  # lines of a training sequence
STEPS, RATE, DECAY = 200, 0.1, 1e-3
CONTENT_SHARE = 0.5
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
FEATURES = ["always", "two words", "eight words", "symbols", "many symbols", "bars", "shouting", "capitals", "equal line", "equal word before", "half equal words", "repeated windows", "many repeated", "sentence end", "digits", "long words", "short words", "capital start"]


def _sums(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[stop] - total[start]


class Lines:
    """Counts of a slice of texts, per document, and features of their lines with a word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        docs = len(offsets) - 1
        words = words_of(data, offsets, lower=False)
        size = len(data)
        inside = np.zeros(size + 1, np.int64)
        np.add.at(inside, words.start, 1)
        np.add.at(inside, words.stop, -1)
        point = (data & 0xC0) != 0x80
        in_word = np.cumsum(inside[:-1]) > 0
        symbols = _SYMBOLS[data]
        self.n_words = words.per_doc()
        self.word_chars = _sums(point & in_word, offsets[:-1], offsets[1:])
        self.n_symbols = _sums(symbols, offsets[:-1], offsets[1:])
        breaks = np.flatnonzero(data == 10)
        start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
        start = start[start < size]
        stop = np.minimum(np.append(start[1:], size), size)
        newline = np.zeros(len(start), bool)
        if len(start):
            newline = data[stop - 1] == 10
        stop = stop - newline
        first, last = np.searchsorted(words.start, start), np.searchsorted(words.start, stop)
        full = last > first
        start, stop, first, last = start[full], stop[full], first[full], last[full]
        self.doc = np.searchsorted(offsets, start, "right") - 1
        self.words = last - first
        own = Prefix(data).of(start, stop)
        order = np.lexsort((np.arange(len(own)), own, self.doc))
        again = np.zeros(len(own), bool)
        if len(own):
            again[order[1:]] = (own[order[1:]] == own[order[:-1]]) & (self.doc[order[1:]] == self.doc[order[:-1]])
        self.n_dup_lines = np.bincount(self.doc[again], minlength=docs)
        covered = self._repeated(words)
        self.n_repeat_words = np.bincount(words.doc[covered], minlength=docs)
        same = np.zeros(len(words.hash), bool)
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        chars = np.maximum(1, _sums(point & in_word, start, stop))
        upper, letters = (data >= 65) & (data <= 90), ((data | 32) >= 97) & ((data | 32) <= 122)
        share = lambda flags: _sums(flags, start, stop) / chars
        of_words = lambda flags: _sums(flags, first, last) / self.words
        n_symbols = share(symbols)
        capitals = _sums(upper, start, stop) / np.maximum(1, _sums(letters, start, stop))
        end, head = data[words.stop[last - 1] - 1], data[words.start[first]]
        equal, repeat = of_words(same), of_words(covered)
        self.features = np.stack(
            [
                np.ones(len(start), bool), self.words <= 2, self.words >= 8, n_symbols > 0, n_symbols > 0.05, _sums(data == 124, start, stop) / self.words > 0.3, share(data == 33) > 0.1, capitals > 0.5, again, equal > 0,
                equal > 0.5, repeat > 0.2, repeat > 0.6, np.isin(end, np.frombuffer(b".!?:;\"'", np.uint8)), share((data >= 48) & (data <= 57)) > 0.1, chars / self.words > 10, chars / self.words < 3, (head >= 65) & (head <= 90) | (head >= 128),
            ],
            axis=1,
        ).reshape(len(start), len(FEATURES))

    @staticmethod
    def _repeated(words) -> np.ndarray:
        """Words in a five-word window that its document has at least twice."""
        count = len(words.hash)
        covered = np.zeros(count, bool)
        if count < WINDOW:
            return covered
        windows = np.zeros(count - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            windows = mix(windows + words.hash[k : k + len(windows)])
        at = np.flatnonzero(words.doc[: len(windows)] == words.doc[WINDOW - 1 :])
        order = at[np.lexsort((windows[at], words.doc[at]))]
        equal = (windows[order[1:]] == windows[order[:-1]]) & (words.doc[order[1:]] == words.doc[order[:-1]])
        twice = np.concatenate([order[1:][equal], order[:-1][equal]])
        for k in range(WINDOW):
            covered[twice + k] = True
        return covered


def viterbi(doc: np.ndarray, scores: np.ndarray, moves: np.ndarray, docs: int) -> np.ndarray:
    """Best labels of all chains at once; doc is sorted, scores is lines x labels, moves is label before x label."""
    sizes = np.bincount(doc, minlength=docs)
    firsts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max()) if docs else 0
    live = np.searchsorted(-sizes[order], -np.arange(longest), "left")  # chains with more than t lines
    best, back = scores.astype(np.float64).copy(), np.zeros(scores.shape, np.int8)
    for t in range(1, longest):
        rows = firsts[order[: live[t]]] + t
        through = best[rows - 1][:, :, None] + moves[None, :, :]
        back[rows] = through.argmax(1)
        best[rows] += through.max(1)
    labels = np.zeros(len(doc), np.int8)
    some = order[: live[0]] if longest else order[:0]
    labels[firsts[some] + sizes[some] - 1] = best[firsts[some] + sizes[some] - 1].argmax(1)
    for t in range(longest - 1, 0, -1):
        rows = firsts[order[: live[t]]] + t
        labels[rows - 1] = back[rows, labels[rows]]
    return labels


def fit(doc: np.ndarray, features: np.ndarray, good: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels; 1 is content) and moves by gradient ascent on the log-likelihood of chunks of chains."""
    weights, moves = np.zeros((features.shape[1], 2)), np.zeros((2, 2))
    if not len(doc):
        return weights, moves
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    starts = np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
    place = np.arange(len(doc)) - starts
    chain = np.cumsum(place % CHUNK == 0) - 1
    place = place % CHUNK
    count = chain[-1] + 1
    mask = np.zeros((count, CHUNK), bool)
    mask[chain, place] = True
    line = np.zeros((count, CHUNK), np.int64)
    line[chain, place] = np.arange(len(doc))
    truth = good[doc].astype(np.int64)
    value = features.astype(np.float64)
    balance = np.where(truth == 1, 0.5 / max(1, (truth == 1).sum()), 0.5 / max(1, (truth == 0).sum()))
    per_chain = balance[line[:, 0]]  # all lines of a chain have one label
    pairs = np.array([mask[:, 1:].sum(1)])[0]
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        node = value @ weights
        score = np.where(mask[:, :, None], node[line], 0.0)
        forward = np.zeros((count, CHUNK, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, CHUNK):
            through = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves[None], axis=1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], through, forward[:, t - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        backward = np.zeros((count, CHUNK, 2))
        expected_moves = np.zeros((count, 2, 2))
        for t in range(CHUNK - 2, -1, -1):
            ahead = moves[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :]
            on = mask[:, t + 1, None]
            backward[:, t] = np.where(on, np.logaddexp.reduce(ahead, axis=2), backward[:, t + 1])
            expected_moves += np.where(on[:, :, None], np.exp(forward[:, t, :, None] + ahead - total[:, None, None]), 0)
        chance = np.exp(forward + backward - total[:, None, None])[chain, place]
        wrong = (np.eye(2)[truth] - chance) * balance[:, None]
        seen = np.zeros((count, 2, 2))
        seen[np.arange(count), truth[line[:, 0]], truth[line[:, 0]]] = pairs
        slopes = (value.T @ wrong - DECAY * weights, ((seen - expected_moves) * per_chain[:, None, None]).sum(0) - DECAY * moves)
        for at, (values, slope) in enumerate(zip((weights, moves), slopes)):
            state[2 * at] = 0.9 * state[2 * at] + 0.1 * slope
            state[2 * at + 1] = 0.999 * state[2 * at + 1] + 0.001 * slope**2
            values += RATE * state[2 * at] / (1 - 0.9**step) / (np.sqrt(state[2 * at + 1] / (1 - 0.999**step)) + 1e-9)
    return weights, moves


def _sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.int64(1) << np.arange(len(FEATURES))
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        lines = Lines(data, offsets)
        bounds = np.searchsorted(lines.doc, np.arange(len(offsets))).astype(np.int32)
        codes = (lines.features * bits).sum(1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(codes))], names=["doc_id", "quality", "lines"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most so many labelled documents (those with the smallest hash of their id)."""
    docs, labels = at_least(docs, ["doc_id", "text"]), at_least(labels, ["doc_id", "quality"])
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")  # at most `sample` pairs of numbers
    rows = rows.mapInArrow(_sample_lines, "doc_id bigint, quality int, lines array<bigint>").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros((0, len(FEATURES)), bool), np.zeros(0, bool))
    lists = rows.column("lines").combine_chunks()
    codes = lists.flatten().to_numpy()
    doc = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
    return fit(doc, (codes[:, None] >> np.arange(len(FEATURES))) & 1 == 1, rows.column("quality").to_numpy() > 0)


def _judge(batches: Iterator[pa.RecordBatch], weights: np.ndarray, moves: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for first, last in slices(offsets):
            own = offsets[first : last + 1]
            lines, docs = Lines(data[own[0] : own[-1]], own - own[0]), last - first
            labels = viterbi(lines.doc, lines.features @ weights, moves, docs)
            good = np.bincount(lines.doc, lines.words * labels, docs)
            share = good / np.maximum(1, lines.n_words)
            failed = (lines.n_words < LEAST_WORDS) | (100 * lines.n_repeat_words > REPEAT_PERCENT * lines.n_words)
            counts = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words]
            content = np.bincount(lines.doc, labels, docs).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, docs), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(np.bincount(lines.doc, minlength=docs).astype(np.int64)), pa.array(content), pa.array(share), pa.array(failed), pa.array(~failed & (share >= CONTENT_SHARE))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines", "content_share", "base_failed", "kept"],
            )


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the counts, n_lines, n_content_lines, content_share, base_failed and kept of every whole text.

    Words are not lowered; lines are split at newlines, and only those with a word count. Null, empty and blank texts have no
    words and fail the base rules; repeated rows and null ids stay; other columns are ignored; without labels every
    line counts as boilerplate or content by the tie rule (boilerplate), so only labelled data can keep documents.
    """
    weights, moves = train(docs, labels, sample)
    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_content_lines bigint, content_share double, base_failed boolean, kept boolean"
    return at_least(docs, ["doc_id", "text"]).mapInArrow(partial(_judge, weights=weights, moves=moves), schema)


@register("op2_line_labels")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
