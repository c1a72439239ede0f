"""Removal of personal data, and of the terms that give it away.

Patterns find the protected entities: e-mail addresses, IP addresses, card and phone numbers. How much a term reveals of an entity
is estimated from the corpus. A context is the terms around a mention of an entity; equal contexts count once, so
that copies of a text are no evidence. With p the share of the documents with a term that have it in a context of the entity, and I the
information content of the entity, log2(documents / contexts of the entity), the pointwise mutual information of both is
I + log2 p, and the disclosure is that as a share of I. A term that stands in some contexts of an entity and discloses
most of it is generalised to its class where it is near a mention of that entity: a word, a name, a number or a code. Where the class discloses
the entity too, the term is removed.

1. One scan finds mentions, contexts and the places of the terms in them, and writes a row for each document.
2. Pairs of entity and term are counted from there, with map-side aggregation; the number of terms is linear in the mentions.
3. A second scan counts the documents with each term, summed up inside tasks before the shuffle.
4. Pairs over the threshold go back to the documents they came from by hash, spread where one pair is very common.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.skew import attach_per_key
from docloom.llm.columnar import binary, buffers, distinct, mix, signed, slices, words_of
from docloom.llm.tables import at_least, register, row_key, table
from docloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
CLASSES = ("word", "name", "number", "code")
WINDOW = 10  # terms on each side of a mention that are its context
CONTEXTS = 3  # different contexts of an entity that a term must stand in to be judged
DISCLOSURE = 0.8  # share of the entity's information from which a term gives it away
HELD_TERMS = 1 << 20  # different terms counted in a task before they are handed on

# The patterns of the query's contract. What a failing match has read can't start another one, so quantifiers may be possessive,
# and a run of digits is tried from its start only: reading is linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters A-Z become small, other ASCII characters than letters and digits become blanks.
_TERMS = np.arange(256, dtype=np.uint8)
_TERMS[[c for c in range(128) if not chr(c).isalnum()]] = 32
_TERMS[65:91] += 32
_CLASS_HASH = mix(np.arange(1, len(CLASSES) + 1, dtype=np.uint64))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the whole run before an @, back to the last match at most."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        if at > end:
            before = text[max(end, text.rfind("@", end, at) + 1) : at]
            run = _LOCAL.match(before[::-1])
            begin = at - (run.end() if run else 0)
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            end = found.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, entity) of the patterns' matches, ordered by start and then kind; places are code points."""
    out = []
    if "@" in text:
        out += [(a, 0, b, text[a:b].lower()) for a, b in _emails(text)]
    for found in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in found[0].split(".")]
        if all(len(p) < 4 and int(p) < 256 for p in parts):
            out.append((found.start(), 1, found.end(), ".".join(parts)))
    for found in _CARD.finditer(text):
        digits = found[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((found.start(), 2, found.end(), digits))
    if "+" in text:
        for found in _PHONE.finditer(text):
            digits = "".join(c for c in found[0] if c in "0123456789")
            if 9 <= len(digits) <= 15:
                out.append((found.start(), 3, found.end(), "+" + digits))
    return sorted(out)


def entity_hash(kind: int, entity: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{entity}".encode(), digest_size=8).digest(), "little", signed=True)


def terms_of(data: np.ndarray, offsets: np.ndarray):
    """Terms of texts (runs of letters, digits and characters beyond ASCII; A-Z made small), and the class of each."""
    words = words_of(_TERMS[data], offsets, lower=False)
    figure = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    figures = figure[words.stop] - figure[words.start]
    size = words.stop - words.start
    first = data[words.start] if len(size) else np.zeros(0, np.uint8)
    kind = np.where(figures == size, 2, np.where(figures > 0, 3, np.where((first >= 65) & (first <= 90), 1, 0)))
    return words, kind


FOUND = (
    "doc_id bigint, row binary, kinds array<int>, starts array<bigint>, stops array<bigint>, mentions array<struct<entity: bigint, context: bigint, terms: array<bigint>>>, "
    "places array<struct<term: bigint, class: int, start: bigint, stop: bigint>>"
)
_MENTIONS = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("terms", pa.list_(pa.int64()))]))
_PLACES = pa.list_(pa.struct([("term", pa.int64()), ("class", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))


def _contexts(text: str, spans: list[tuple[int, int, int, str]], window: int) -> tuple[list[dict], list[dict]]:
    """Mentions with their contexts, and all places of the contexts' terms in the text."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    words, kind = terms_of(data, np.array([0, len(data)]))
    point = np.cumsum((data & 0xC0) != 0x80) - 1  # code point of each byte
    start, stop = point[words.start], point[words.stop - 1] + 1
    inside = np.zeros(len(start), bool)
    for a, _, b, _ in spans:
        inside[np.searchsorted(stop, a, "right") : np.searchsorted(start, b, "left")] = True
    free = ~inside
    start, stop, kind, term = start[free], stop[free], kind[free], words.hash[free]
    mentions, used = [], []
    for a, k, b, entity in spans:
        left, right = np.searchsorted(stop, a, "right"), np.searchsorted(start, b, "left")
        near = np.r_[max(0, left - window) : left, right : min(len(start), right + window)]
        seen = term[near]
        context = np.bitwise_xor.reduce(mix(seen + np.arange(len(seen), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) if len(seen) else np.uint64(0)
        found = np.unique(np.concatenate([seen, _CLASS_HASH[kind[near]]]))
        mentions.append({"entity": entity_hash(k, entity), "context": int(np.uint64(context).astype(np.int64)), "terms": signed(found).tolist()})
        used.append(seen)
    asked = np.flatnonzero(np.isin(term, np.concatenate(used))) if used else np.zeros(0, int)
    places = [{"term": t, "class": c, "start": a, "stop": b} for t, c, a, b in zip(signed(term[asked]).tolist(), kind[asked].tolist(), start[asked].tolist(), stop[asked].tolist())]
    return mentions, places


def _find(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            spans = base_spans(text)
            mentions, places = _contexts(text, spans, window) if spans else ([], [])
            rows.append(([s[1] for s in spans], [s[0] for s in spans], [s[2] for s in spans], mentions, places))
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), _MENTIONS, _PLACES))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *columns], names=["doc_id", "row", "kinds", "starts", "stops", "mentions", "places"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) summed over many documents: how many have the term; classes count as terms."""
    held_terms, held_counts, held = [], [], 0

    def summed() -> pa.RecordBatch:
        terms, at = np.unique(np.concatenate(held_terms), return_inverse=True)
        counts = np.bincount(at, np.concatenate(held_counts)).astype(np.int64)
        held_terms[:], held_counts[:] = [terms], [counts]
        return pa.RecordBatch.from_arrays([pa.array(signed(terms)), pa.array(counts)], names=["term", "n"])

    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for first, last in slices(offsets):
            own = offsets[first : last + 1]
            words, kind = terms_of(data[own[0] : own[-1]], own - own[0])
            _, terms = distinct(np.concatenate([words.doc, words.doc]), np.concatenate([words.hash, _CLASS_HASH[kind]]))
            terms, counts = np.unique(terms, return_counts=True)
            held_terms.append(terms)
            held_counts.append(counts)
            held += len(terms)
            if held >= HELD_TERMS:
                done = summed()
                held = done.num_rows
                if held >= HELD_TERMS // 2:
                    yield done
                    held_terms, held_counts, held = [], [], 0
    if held:
        yield summed()


def disclosing(found: DataFrame, docs: DataFrame, contexts: int = CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term, removed) of the terms that give an entity away.

    found has the mentions of docs. removed says of each class whether it gives the entity away too.
    """
    mentions = found.where("size(mentions) > 0").select(F.explode("mentions").alias("m")).select("m.*")
    different = cut_lineage(mentions.groupBy("entity", "context").agg(F.first("terms").alias("terms")))
    entities = different.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= contexts)
    pairs = different.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= contexts)
    pairs = cut_lineage(pairs.join(entities, "entity"))
    counts = at_least(docs, ["text"]).mapInArrow(_document_counts, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))
    counts = pairs.select("term").distinct().join(counts, "term")
    documents = docs.count()
    share = F.col("n_both") / F.greatest("n_term", "n_both")
    information = F.log2(F.lit(float(documents)) / F.col("n_entity"))
    told = F.when(information > 0, 1 + F.log2(share) / information).otherwise(0.0)
    judged = pairs.join(counts, "term").select("entity", "term", (told >= disclosure).alias("told"))
    class_of = [F.col("term") == F.lit(int(h)) for h in signed(_CLASS_HASH)]
    is_class = F.col("term").isin([int(h) for h in signed(_CLASS_HASH)])
    classes = judged.where(is_class).groupBy("entity").agg(*[F.coalesce(F.bool_or(c & F.col("told")), F.lit(False)).alias(f"c{k}") for k, c in enumerate(class_of)])
    told_of_class = F.array(*[F.coalesce(f"c{k}", F.lit(False)) for k in range(len(CLASSES))])
    return judged.where(F.col("told") & ~is_class).join(classes, "entity", "left").select("entity", "term", told_of_class.alias("removed"))


def find(docs: DataFrame, window: int = WINDOW, contexts: int = CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """One row for each document: doc_id, row (hash of doc_id and text), kinds, starts and stops of the patterns' matches, and terms
    (array of start, stop, class, removed) that give away an entity mentioned near them.

    Places are code points. Null texts are empty; empty texts have no spans. Repeated rows, equal and null doc_ids have a row each; copies add no
    evidence. A text of any length is read in time linear in it. Other columns are ignored; an empty table gives no rows.
    """
    docs = at_least(docs, ["doc_id", "text"])
    found = cut_lineage(docs.withColumn("row", row_key()).mapInArrow(partial(_find, window=window), FOUND))
    told = disclosing(found, docs, contexts, disclosure)
    some = found.where("size(mentions) > 0")
    terms = some.select("row", F.explode("mentions").alias("m")).select("row", "m.entity", F.explode("m.terms").alias("term"))
    # One row for each document, entity and term, however often it is repeated.
    terms = cut_lineage(terms.distinct())
    common = terms.groupBy("entity", "term").agg(F.count("*").alias("_n")).join(told, ["entity", "term"])
    marked = attach_per_key(terms, cut_lineage(common), ["entity", "term"], "_n", "row")
    marked = marked.groupBy("row", "term").agg(*[F.bool_or(F.col("removed")[k]).alias(f"c{k}") for k in range(len(CLASSES))])
    places = some.groupBy("row").agg(F.first("places").alias("places")).select("row", F.explode("places").alias("p"))
    removed = F.array(*[F.col(f"c{k}") for k in range(len(CLASSES))])[F.col("p.class")]
    span = F.struct("p.start", "p.stop", F.col("p.class").alias("class"), removed.alias("removed"))
    spans = places.withColumn("term", F.col("p.term")).join(marked, ["row", "term"]).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("terms"))
    none = F.array().cast("array<struct<start: bigint, stop: bigint, class: int, removed: boolean>>")
    columns = ["doc_id", "row", "kinds", "starts", "stops"]
    joined = some.select(*columns).join(spans, "row", "left").select(*columns, F.coalesce("terms", none).alias("terms"))
    return joined.unionByName(found.where("size(mentions) = 0").select(*columns, none.alias("terms")))


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, kinds, starts, stops, terms in zip(*(batch.column(c).to_pylist() for c in ("text", "kinds", "starts", "stops", "terms"))):
            if text is not None:
                cuts = [(a, b, f"[{KINDS[k].upper()}]") for k, a, b in zip(kinds or [], starts or [], stops or [])]
                cuts = sorted(cuts + [(t["start"], t["stop"], "" if t["removed"] else f"[{CLASSES[t['class']].upper()}]") for t in terms or []])
                out, at = [], 0
                for a, b, new in cuts:  # matches of two kinds may overlap: what is left of the later one goes too
                    if b > at:
                        out += [text[at:a], new] if a >= at else []
                        at = b
                text = "".join(out) + text[at:]
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def sanitised(docs: DataFrame, window: int = WINDOW, contexts: int = CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """(doc_id, text) with entities and telling terms replaced by their kind or class in brackets, or removed; null texts stay null."""
    docs = at_least(docs, ["doc_id", "text"])
    found = find(docs, window, contexts, disclosure).where("size(kinds) > 0").dropDuplicates(["row"]).drop("doc_id")
    return docs.withColumn("row", row_key()).join(found, "row", "left").mapInArrow(_written, "doc_id bigint, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for kinds, starts, stops, terms in zip(*(batch.column(c).to_pylist() for c in ("kinds", "starts", "stops", "terms"))):
            base = [(a, k, b) for k, a, b in zip(kinds, starts, stops)]
            every = sorted(base + [(t["start"], len(KINDS), t["stop"]) for t in terms])
            said = [",".join(f"{(*KINDS, 'term')[k]}:{a}:{b}" for a, k, b in spans) for spans in (base, every)]
            rows.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(said[0].encode()).hexdigest(), said[1], len(terms)))
        kinds_ = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]
        names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_terms"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds_))], names=["doc_id", *names])


@register("op11_disclosing_terms")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = find(table(spark, folder, "documents"))
    return found.mapInArrow(_digests, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_terms bigint")
