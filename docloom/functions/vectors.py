"""Vector maths: built-in expressions for short vectors, Arrow batches for embedding text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

try:
    from _md5 import md5  # the interpreter's own, about twice as fast on short words as the one of hashlib
except ImportError:
    from hashlib import md5

_WORDS = re.compile(r"\w+")
_HAN = re.compile("[一-鿿]")
DIGESTS_AT_ONCE = 16_384


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x
    )


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(left: Column, right: Column) -> Column:
    """0 when either side is empty, the sizes differ, or a norm is zero."""
    size = norm(left) * norm(right)
    comparable = (F.size(left) > 0) & (F.size(left) == F.size(right)) & (size > 0)
    return F.when(comparable, dot(left, right) / size).otherwise(F.lit(0.0))


def unit(vector: Column) -> Column:
    """L2-normalised; a zero vector is returned as it is."""
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length)).otherwise(vector.cast("array<double>"))


def mean_vectors(df: DataFrame, key: list[str], vector: str, output: str = "mean_vector") -> DataFrame:
    """Element-wise mean per key; missing vectors do not count.

    One running mean per key is kept in each task and only those travel, so neither a key with very
    many rows nor long vectors make the shuffle grow.
    """
    present = df.where(F.col(vector).isNotNull()).select(*key, array_to_vector(F.col(vector).cast("array<double>")).alias("_vector"))
    return present.groupBy(*key).agg(Summarizer.mean(F.col("_vector")).alias("_mean")).select(*key, vector_to_array("_mean").alias(output))


def embed_texts(texts: list[str], dim: int) -> np.ndarray:
    """Signed feature hashing of words and adjacent word pairs, rows of unit length.

    Fixed rule: MD5 as a big-endian integer h; slot h mod dim; sign + when bit 64 of h is set.
    A text without words is the one-hot vector of its own hash.
    """
    out = np.zeros((len(texts), dim))
    known: dict[str, bytes] = {}  # digests of the single words of these texts
    digests: list[bytes] = []
    ends: list[int] = []
    wordless: list[bool] = []
    for row, text in enumerate(texts):
        tokens: list[str] = _WORDS.findall(text.lower())
        if not text.isascii() and _HAN.search(text):
            tokens = [piece for token in tokens for piece in (token if _HAN.search(token) else (token,))]
        if tokens:
            for token in tokens:
                if token not in known:
                    known[token] = md5(token.encode()).digest()
            digests += [known[token] for token in tokens]
            digests += [md5(pair.encode()).digest() for pair in map(" ".join, zip(tokens, tokens[1:]))]
        else:
            digests.append(md5(text.encode()).digest())
        ends.append(len(digests))
        wordless.append(not tokens)
        if len(digests) >= DIGESTS_AT_ONCE or row == len(texts) - 1:
            raw = np.frombuffer(b"".join(digests), dtype=">u4").reshape(len(digests), 4)
            rows = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            signs = np.where((raw[:, 1] & 1).astype(bool) | np.array(wordless)[rows], 1.0, -1.0)
            sums = np.bincount(rows * dim + _slots(raw, dim), weights=signs, minlength=len(ends) * dim)
            out[row + 1 - len(ends) : row + 1] = sums.reshape(len(ends), dim)
            digests, ends, wordless = [], [], []
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(lengths == 0, 1.0, lengths)


def _slots(words: np.ndarray, dim: int) -> np.ndarray:
    """128-bit value modulo ``dim``, folded one 32-bit word at a time."""
    if dim <= 2**32 and dim & (dim - 1) == 0:  # the last bits are the rest
        return (words[:, 3] & np.uint32(dim - 1)).astype(np.int64)
    rest = np.zeros(len(words), dtype=np.uint64)
    for column in range(4):
        rest = ((rest << np.uint64(32)) | words[:, column].astype(np.uint64)) % np.uint64(dim)
    return rest.astype(np.int64)


def hash_embedder(dim: int):
    """The offline embedding port: ``Column[string] -> Column[array<double>]``."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embed_texts(texts.fillna("").tolist(), dim)))

    return embed
