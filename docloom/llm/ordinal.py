"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade > j) = sigmoid(w.x - b_j) with one weight vector for all ordered thresholds b_0 < b_1; the severity is the expected
grade, the sum of these probabilities. Features are the hashed lower-cased words that a text
has, and their beginnings; only those that tell the classes apart in the sample take part. The labels only
say toxic or not, so grades of the training rows are made from them: 0 is not toxic, and toxic texts are 1 or 2 by how
many of the words that set toxic texts apart they have, split at the median.

The model is fitted on a bounded sample of labelled rows (SAMPLE rows with the smallest hash of their id), drawn and
turned into features in Spark; scoring is one scan of all whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.columnar import Prefix, buffers, distinct, mix, slices, words_of
from docloom.llm.tables import at_least, register, table

SAMPLE = 8000  # labelled rows at most
FEATURE_BITS = 18
BEGINNINGS = (4, 5, 6)  # bytes
STEPS, RATE, DECAY = 300, 0.1, 1e-5
TOXIC_SHARE = 0.25  # of the loss, whatever share of the sample is toxic
LEAST_ROWS, CHI_SQUARED = 3, 40.0  # a feature takes part if so many rows have it and it tells the classes apart


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def tail(self, doc: np.ndarray, feature: np.ndarray, docs: int) -> np.ndarray:
        """P(grade > j) of each text, docs x thresholds."""
        sums = np.bincount(doc, self.weights[feature], docs)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - sums[:, None], -60, 60)))


def _features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(_letters(data), offsets)
    prefix, low = Prefix(words.data), np.uint64(64 - bits)
    docs, hashes = [words.doc], [words.hash]
    for size in BEGINNINGS:  # beginnings of longer words, for languages that put words together
        longer = words.stop - words.start > size
        docs.append(words.doc[longer])
        hashes.append(mix(prefix.of(words.start[longer], words.start[longer] + size) + np.uint64(size)))
    doc, hashes = distinct(np.concatenate(docs), np.concatenate(hashes) >> low)
    return doc, hashes.astype(np.int64)


def _letters(data: np.ndarray) -> np.ndarray:
    """ASCII punctuation and digits become spaces, so that a word counts alike with and without them."""
    keep = (data >= 128) | ((data | 32) >= 97) & ((data | 32) <= 122)
    return np.where(keep, data, np.uint8(32))


def _sample_features(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        doc, feature = _features(data, offsets, bits)
        bounds = np.searchsorted(doc, np.arange(len(offsets))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32)))], names=["doc_id", "toxic", "features"])


def grades(toxic: np.ndarray, doc: np.ndarray, feature: np.ndarray, size: int) -> np.ndarray:
    """0, 1 or 2: toxic texts split by how many words they have that are typical of toxic texts."""
    often = np.bincount(feature[toxic[doc] == 1], minlength=size)
    rest = np.bincount(feature[toxic[doc] == 0], minlength=size)
    bad, good = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    typical = (often >= LEAST_ROWS) & ((often + 0.5) / bad > 10 * (rest + 0.5) / good)
    found = np.bincount(doc, typical[feature], len(toxic))
    middle = np.median(found[toxic == 1]) if toxic.any() else 0
    return np.where(toxic == 1, 1 + (found > middle), 0)


def telling(toxic: np.ndarray, doc: np.ndarray, feature: np.ndarray, size: int) -> np.ndarray:
    """Features whose presence depends on toxicity (chi-squared with one degree of freedom); others would only be learned by heart."""
    seen = np.bincount(feature, minlength=size).astype(np.float64)
    bad = np.bincount(feature, toxic[doc].astype(np.float64), size)
    share, rows = toxic.mean(), len(toxic)
    spread = np.maximum(seen * share * (1 - share) * (1 - seen / rows), 1e-9)
    return (seen >= LEAST_ROWS) & ((bad - seen * share) ** 2 / spread >= CHI_SQUARED)


def fit(grade: np.ndarray, doc: np.ndarray, feature: np.ndarray, size: int, steps: int = STEPS) -> Model:
    """Maximum likelihood with all-threshold logistic loss (Adam); without both kinds of rows nothing is severe."""
    levels = 2
    weights, thresholds = np.zeros(size), np.array([2.0, 3.0])
    if not (grade > 0).any() or not (grade == 0).any():
        return Model(weights, np.array([30.0, 31.0]) if not (grade > 0).any() else np.array([-30.0, 30.0]))
    target = (grade[:, None] > np.arange(levels)[None, :]).astype(np.float64)
    share = np.where(grade > 0, TOXIC_SHARE / (grade > 0).sum(), (1 - TOXIC_SHARE) / (grade == 0).sum())[:, None]
    keep = telling(grade > 0, doc, feature, size)[feature]
    doc, feature = doc[keep], feature[keep]
    state = [np.zeros(size), np.zeros(size), np.zeros(levels), np.zeros(levels)]
    for step in range(1, steps + 1):
        tail = Model(weights, thresholds).tail(doc, feature, len(grade))
        wrong = (tail - target) * share
        slope = np.bincount(feature, wrong.sum(1)[doc], size) + DECAY * weights
        for at, (values, grad) in enumerate(((weights, slope), (thresholds, -wrong.sum(0)))):
            state[2 * at] = 0.9 * state[2 * at] + 0.1 * grad
            state[2 * at + 1] = 0.999 * state[2 * at + 1] + 0.001 * grad**2
            values -= RATE * state[2 * at] / (1 - 0.9**step) / (np.sqrt(state[2 * at + 1] / (1 - 0.999**step)) + 1e-9)
        thresholds.sort()
    return Model(weights, thresholds)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = FEATURE_BITS) -> Model:
    """Fit on at most so many labelled rows; unlabelled and null rows are passed over, contradicting labels count as toxic."""
    docs, labels = at_least(docs, ["doc_id", "text"]), at_least(labels, ["doc_id", "toxic"])
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")  # at most `sample` pairs of numbers
    rows = rows.mapInArrow(partial(_sample_features, bits=bits), "doc_id bigint, toxic int, features array<int>").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    toxic = (rows.column("toxic").to_numpy() > 0).astype(np.int64)
    lists = rows.column("features").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    feature = lists.flatten().to_numpy().astype(np.int64) if rows.num_rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy())) if rows.num_rows else np.zeros(0, np.int64)
    return fit(grades(toxic, doc, feature, 1 << bits), doc, feature, 1 << bits)


def _score(batches: Iterator[pa.RecordBatch], model: Model, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        tails = [np.zeros((0, len(model.thresholds)))]
        for first, last in slices(offsets):
            own = offsets[first : last + 1]
            tails.append(model.tail(*_features(data[own[0] : own[-1]], own - own[0], bits), last - first))
        tail = np.concatenate(tails)
        grade = (tail >= 0.5).sum(1)
        columns = [pa.array(np.round(tail.sum(1), 9)), pa.array(np.round(tail[:, 0], 9)), pa.array(np.round(tail[:, 1], 9)), pa.array(grade.astype(np.int32)), pa.array(grade > 0), pa.array(grade == 0)]
        out = pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "severity", "p_mild", "p_severe", "grade", "toxic", "kept"])
        yield out


def severity(docs: DataFrame, model: Model, keep: list[str] | None = None, bits: int = FEATURE_BITS) -> DataFrame:
    """doc_id, severity, p_mild, p_severe, grade, toxic, kept of every whole text, and the named columns of docs.

    severity is the expected grade (0 to 2), p_mild and p_severe are the chances of at least that grade, and toxic is p_mild >= 0.5.
    Null, empty and blank texts have no features and get the base severity; repeated rows and null ids stay;
    an empty table gives no rows.
    """
    columns = list(dict.fromkeys(["doc_id", "text", *(keep or [])]))
    docs = at_least(docs, columns)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", severity double, p_mild double, p_severe double, grade int, toxic boolean, kept boolean"
    return docs.mapInArrow(partial(_score, model=model, bits=bits), schema).select(*(keep or ["doc_id"]), "severity", "p_mild", "p_severe", "grade", "toxic", "kept")


@register("op8_ordinal_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return severity(docs, train(docs, table(spark, folder, "labels")))
