"""Array helpers that run inside tasks: bytes, words and shingles of many texts at once, in numpy.

A null text is an empty text. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which splits
UTF-8 text exactly like the character class does, since no byte of a longer character is below 0x80.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20

# Multipliers of the mixing functions (odd 64-bit constants).
_BASE = 0x9E3779B97F4A7C15
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = values ^ (values >> np.uint64(30))
    values = values * _MIX_A
    values = values ^ (values >> np.uint64(27))
    values = values * _MIX_B
    return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers_up_to(bits: int, base: int) -> np.ndarray:
    powers = np.full(1 << bits, np.uint64(base))
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _powers(count: int, base: int) -> np.ndarray:
    return _powers_up_to(max(16, int(count).bit_length()), base)


class Prefix:
    """Polynomial prefix sums modulo 2^64: the hash of any stretch of bytes in constant time."""

    def __init__(self, data: np.ndarray):
        count = len(data)
        self._up = _powers(count + 1, _BASE)
        self._sums = np.zeros(count + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(count + 1, _INVERSE)[:count], out=self._sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self._sums[stop] - self._sums[start]) * self._up[stop]
        return mix(raw + (stop - start).astype(np.uint64) * _STEP)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string or binary column, without copying the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes each, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


@dataclass
class Words:
    """Words of a slice of texts, in order."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    docs: int

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Words of texts that lie one after another in data; A-Z are lowered on request."""
    docs, size = len(offsets) - 1, len(data)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(size + 1, bool)  # a text ends where the next begins, also without white space
    edge[offsets] = True
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:size]))
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, start, stop, doc, Prefix(data).of(start, stop), docs)


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of so many words; a document with fewer words has all of them as one."""
    count = len(words.hash)
    hashes = np.zeros(max(0, count - size + 1), np.uint64)
    for k in range(size):
        hashes = mix(hashes + words.hash[k : k + len(hashes)]) * _STEP
    whole = words.doc[: len(hashes)] == words.doc[size - 1 :] if len(hashes) else np.zeros(0, bool)
    doc, hashes = words.doc[: len(hashes)][whole], hashes[whole]
    per_doc = words.per_doc()
    short = np.flatnonzero((per_doc > 0) & (per_doc < size))
    if len(short):
        first = np.searchsorted(words.doc, short)
        own = np.full(len(short), np.uint64(0))
        for k in range(size - 1):
            there = per_doc[short] > k
            own[there] = mix(own[there] + words.hash[first[there] + k]) * _STEP
        own = mix(own + per_doc[short].astype(np.uint64))
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, own])
    return doc, hashes


def distinct(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, sorted."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    if not len(doc):
        return doc, hashes
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
