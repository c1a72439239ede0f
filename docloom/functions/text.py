"""Text scalars as Column expressions: everything here runs JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the whitespace class the results are defined over (Unicode, not only ASCII).
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}]+"
HAN = r"[一-鿿]"


def collapse(text: Column) -> Column:
    """Runs of whitespace become one space and the ends are stripped."""
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def normalize(text: Column) -> Column:
    return F.lower(collapse(text))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def chunk_id(document_id: Column, text: Column) -> Column:
    digest = F.sha1(F.encode(normalize(text), "UTF-8"))
    return F.concat(document_id.cast("string"), F.lit(":"), F.substring(digest, 1, 16))


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by whitespace; blanks dropped."""
    parts = F.split(text, r"(?<=[.!?])" + WHITESPACE + "+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``; a plain reference inside a lambda would redo it per element."""
    return F.get(F.transform(F.array(value), body), 0)


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct word n-grams; a shorter text is its own single shingle, an empty one has none."""

    def grams(tokens: Column) -> Column:
        count = F.size(tokens)
        windows = F.transform(
            F.sequence(F.lit(1), F.greatest(count - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, size), " ")
        )
        return F.when(count == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(windows))

    return let(words(text), grams)


# --- analyzers -------------------------------------------------------------

# Accented letters and what they fold to.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
_FOLDED = "aaaaaaceeeeiiiinoooooouuuuyy"


def fold(text: Column) -> Column:
    lowered = F.translate(F.lower(text), _ACCENTED, _FOLDED)
    return F.replace(F.replace(F.replace(lowered, F.lit("ß"), F.lit("ss")), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))


def standard_terms(text: Column) -> Column:
    """Lower-cased words; every Han ideograph is a term of its own."""
    spaced = F.regexp_replace(F.lower(text), f"({HAN})", " $1 ")
    return F.regexp_extract_all(spaced, F.lit(WORD), F.lit(0))


def plain_terms(text: Column) -> Column:
    return standard_terms(fold(text))


def cjk_terms(text: Column) -> Column:
    """Words outside Han runs, plus the overlapping pairs of every Han run (lone ideographs stay single)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"{HAN}+|[\p{{L}}\p{{N}}&&[^一-鿿]]+"), F.lit(0))
    pairs = F.transform(
        runs,
        lambda run: F.when(
            run.rlike("^" + HAN) & (F.length(run) > 1),
            F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2))),
        ).otherwise(F.array(run)),
    )
    return F.flatten(pairs)


def edge_grams(terms: Column, low: int = 2, high: int = 20) -> Column:
    def prefixes(term: Column) -> Column:
        longest = F.least(F.length(term), F.lit(high))
        return F.when(
            F.length(term) >= low,
            F.transform(F.sequence(F.lit(low), F.greatest(longest, F.lit(low))), lambda n: F.substr(term, F.lit(1), n)),
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(terms, prefixes)))


def char_grams(terms: Column, size: int = 3) -> Column:
    def grams(term: Column) -> Column:
        return F.when(
            F.length(term) >= size,
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(term) - (size - 1), F.lit(1))), lambda i: F.substr(term, i, F.lit(size))),
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(terms, grams)))


def term_shingles(terms: Column, low: int = 2, high: int = 3) -> Column:
    """Unigrams followed by word n-grams of every size in ``low..high``."""

    def sized(tokens: Column, size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (size - 1), F.lit(1)))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, size), " "))
        return F.when(F.size(tokens) >= size, joined).otherwise(F.array().cast("array<string>"))

    return let(terms, lambda tokens: F.concat(tokens, *[sized(tokens, size) for size in range(low, high + 1)]))


def auto_distance(term: Column) -> Column:
    """Edits allowed by term length: 0 up to two characters, 1 up to five, 2 beyond."""
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


def within_edits(left: Column, right: Column, limit: Column) -> Column:
    """Length filter first, so the quadratic distance only runs on plausible pairs."""
    return (F.abs(F.length(left) - F.length(right)) <= limit) & (F.levenshtein(left, right) <= limit)


def _segment(length: Column, parts: int, j: int) -> tuple[Column, Column]:
    """(start, size) of the j-th of ``parts`` nearly equal pieces of a word; longer pieces come last."""
    base = F.floor(length / parts).cast("int")
    longer_from = parts - F.pmod(length, F.lit(parts))
    return base * j + F.greatest(F.lit(j) - longer_from, F.lit(0)) + 1, base + (F.lit(j) >= longer_from).cast("int")


def segment_keys(word: Column) -> Column:
    """Keys of a vocabulary word: its pieces when cut in one, two and three, with its length."""
    keys = []
    for edits in (0, 1, 2):
        for j in range(edits + 1):
            start, size = _segment(F.length(word), edits + 1, j)
            keys.append(_key(edits, F.length(word), j, F.substr(word, start, size)))
    return F.array(*keys)


def probe_keys(word: Column, limit: Column) -> Column:
    """Keys of a searched word that meet every vocabulary word within ``limit`` (0, 1 or 2) edits.

    Of ``limit + 1`` pieces of a word at least one survives that many edits, moved by at most
    ``limit`` places, so equality of keys finds every match through a plain equi-join.
    """
    probes = F.array().cast("array<string>")
    for edits in (0, 1, 2):
        found = []
        for j in range(edits + 1):

            def at_length(other: Column, edits: int = edits, j: int = j) -> Column:
                start, size = _segment(other, edits + 1, j)
                low, high = F.greatest(F.lit(1), start - edits), F.least(F.length(word) - size + 1, start + edits)
                places = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
                return F.transform(places, lambda p: _key(edits, other, j, F.substr(word, p, size)))

            lengths = F.sequence(F.greatest(F.length(word) - edits, F.lit(edits + 1)), F.greatest(F.length(word) + edits, F.lit(edits + 1)))
            found.append(F.flatten(F.transform(lengths, _one_argument(at_length))))
        probes = F.when(limit == edits, F.concat(*found)).otherwise(probes)
    return F.array_distinct(probes)


def _one_argument(function: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Hide default arguments, which a lambda for Spark would take for the element index."""
    return lambda element: function(element)


def _key(edits: int, length: Column, j: int, piece: Column) -> Column:
    return F.concat(F.lit(f"{edits}:{j}:"), length.cast("string"), F.lit(":"), piece)
