"""Chat formatting by columnar byte assembly.

A turn becomes ``<turn ROLE>`` newline TEXT ``</turn>`` newline. Inside roles and texts the bytes ``\\``, ``<`` and ``>`` get a backslash
before them, so no text can hold a control string and everything can be read back. Rows are dealt out and sorted by
conversation and turn; for each batch the lengths of all segments are computed, their cumulative sums give each segment's
place, and scatter indices copy headers, contents and ends into one preallocated buffer that becomes the Arrow column as it is.

A row of output is a turn; a conversation is its rows in order. So the longest conversation passes through
a task batch by batch, and reading back keeps running digests instead of whole conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.columnar import buffers
from docloom.llm.tables import at_least, register, table

# The template.
HEAD, HEAD_END, TAIL = b"<turn ", b">\n", b"</turn>\n"
ESCAPE = 92
_SPECIAL = np.zeros(256, bool)
_SPECIAL[[92, 60, 62]] = True
LOSS_ROLE = "assistant"
FORMATTED = "conv_id bigint, turn bigint, formatted binary, loss_start bigint, loss_bytes bigint"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with a backslash before each special one, and the new offsets."""
    special = _SPECIAL[data]
    shift = np.concatenate([[0], np.cumsum(special)])
    out = np.full(len(data) + int(shift[-1]), np.uint8(ESCAPE))
    out[np.arange(len(data)) + shift[1:]] = data
    return out, offsets + shift[offsets]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy each row's bytes to its place."""
    lengths = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], lengths) + np.arange(offsets[-1])] = data


def _fixed(out: np.ndarray, at: np.ndarray, piece: bytes) -> None:
    out[at[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns as one column, and where the escaped text of each starts and how long it is."""
    role, role_at = escaped(*buffers(roles))
    text, text_at = escaped(*buffers(texts))
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    total = len(HEAD) + role_size + len(HEAD_END) + text_size + len(TAIL)
    ends = np.cumsum(total)
    start = ends - total
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    _fixed(out, start, HEAD)
    _scatter(out, start + len(HEAD), role, role_at)
    _fixed(out, start + len(HEAD) + role_size, HEAD_END)
    body = start + len(HEAD) + role_size + len(HEAD_END)
    _scatter(out, body, text, text_at)
    _fixed(out, body + text_size, TAIL)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(total), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    return column, body - start, text_size


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, start, size = assemble(batch.column("role"), batch.column("text"))
        loss = np.array([r == LOSS_ROLE for r in batch.column("role").to_pylist()], bool)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), column.cast(pa.binary()), pa.array(start.astype(np.int64), mask=~loss), pa.array(size.astype(np.int64), mask=~loss)], names=["conv_id", "turn", "formatted", "loss_start", "loss_bytes"]
        )


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted (bytes), loss_start and loss_bytes (bytes of the escaped assistant text; null for other roles).

    All rows of a conversation are in one partition, in order of turn (null first), then role and text. Null texts and
    roles are empty; rows with a null conv_id are one conversation; repeated rows are turns of their own; other columns are ignored;
    an empty table gives no rows.
    """
    ordered = at_least(turns, ["conv_id", "turn", "role", "text"]).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format, FORMATTED)


def unescape(data: bytes) -> bytes:
    raw = np.frombuffer(data, np.uint8)
    if ESCAPE not in data:
        return data
    marks = raw == ESCAPE
    at = np.arange(len(raw))
    run = at - np.maximum.accumulate(np.where(marks, -1, at))  # backslashes in a row up to here
    return raw[~(marks & (run % 2 == 1))].tobytes()


def read_turn(formatted: bytes) -> tuple[bytes, bytes]:
    """Role and text of one formatted turn; anything but one whole turn is an error."""
    end = formatted.find(HEAD_END)
    while end > 0 and (end - len(formatted[:end].rstrip(b"\\"))) % 2:  # an escaped bracket
        end = formatted.find(HEAD_END, end + 1)
    if not formatted.startswith(HEAD) or end < 0 or not formatted.endswith(TAIL):
        raise ValueError("not a turn")
    return unescape(formatted[len(HEAD) : end]), unescape(formatted[end + len(HEAD_END) : -len(TAIL)])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    key, state = object(), None
    for batch in batches:
        rows: list[tuple] = []
        for conv, formatted, start, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_bytes"))):
            if conv != key:
                if state:
                    rows.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_turn(formatted)
            state[0] += 1
            state[1].update(role + b"\n" + text + b"\n")
            if start is not None:
                loss = unescape(formatted[start : start + size])
                state[2] += len(loss.decode("utf-8", "surrogatepass"))
                state[3].update(loss)
            state[4] += len(formatted.decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
    if state:
        row = (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, parsed from its formatted rows."""
    return formatted.mapInArrow(_digests, DIGEST)


_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '<', '\<'), '>', '\>')"
ORACLE = rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 16) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


@register("op10_chat_bytes", ORACLE)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    turns = at_least(table(spark, folder, "conversations"), ["conv_id", "turn", "role", "text"])
    return read_back(format_turns(turns.unionByName(extra)))
