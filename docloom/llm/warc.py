"""WARC archives: records as gzip members, written by Spark, and a splittable reader.

Writing uses Spark's own file writer, so archives go to any store that Spark can write: a row is one compressed
record, and the line separator is an empty gzip member, which keeps the file a valid chain of members.

Reading uses Spark's byte ranges: the separator of the text reader is the gzip magic number, so a task scans its range of
a file, finds candidate members, and owns those whose magic starts inside the range, reading on past its end. A
candidate is a member only if its header decodes, it inflates, and what it holds starts as a WARC record; magic
bytes that happen to lie inside a member are joined to it again. Where such bytes lie at the border of two ranges, the two
unfinished pieces meet in a second, tiny step by file. Inflated records pass one at a time.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.columnar import binary
from docloom.llm.tables import at_least, ready, register, table
from docloom.session import shared_folder

MAGIC = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"
LEAST_BYTES = 100  # smaller payloads are never revisited
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
LEFT = "file string, block bigint, number bigint, kind string, piece binary"


def member(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


#: An empty member: ends one record and begins none.
SEPARATOR = member(b"")


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the HTTP headers (with the payload's length) and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "revisit")))
        yield pa.RecordBatch.from_arrays([binary([member(record(p, u, (h or "").encode("utf-8", "surrogatepass"), d, f, r)) for p, u, h, d, f, r in rows])], names=["member"])


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> None:
    """Archives of all page rows; equal payloads of at least so many bytes are stored once, under the smallest page_id.

    A null html is an empty payload. Rows that share payload and smallest page_id are all responses; a row whose page_id
    is null revisits whenever another id has the payload. Other columns are ignored.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = at_least(pages, ["page_id", "url", "html"]).withColumn("digest", F.sha2(payload, 256)).withColumn("size", F.octet_length(F.coalesce("html", F.lit(""))))
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    members = rows.select("page_id", "url", "html", "digest", "first", "revisit").mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).text(folder)


def parse(data: bytes) -> tuple | None:
    """The fields of a WARC record of a page, or None for other records."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
    kind = fields.get("WARC-Type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    number = {k: re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To")}
    page, refers = (int(m[1]) if m else None for m in (number["WARC-Record-ID"], number["WARC-Refers-To"]))
    url = fields.get("WARC-Target-URI")
    url = None if url is None else re.sub(r"%([01][0-9A-F]|20|25|7F)", lambda m: chr(int(m[1], 16)), url)
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    size = int(length[1]) if length else len(payload)
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"the payload of {fields.get('WARC-Record-ID')} does not match its digest")
    return page, url, kind, refers, size, digest, payload if kind == "response" else None


class Inflater:
    """A member that may need more than one piece."""

    def __init__(self, piece: bytes):
        self.raw, self.data, self.done = b"", b"", False
        self.engine = zlib.decompressobj(31)
        self.add(piece)

    def add(self, piece: bytes) -> None:
        self.raw += piece
        self.data += self.engine.decompress(piece)
        self.done = self.engine.eof
        if self.done and self.engine.unused_data:
            raise zlib.error("bytes after the member")
        if len(self.data) >= 5 and not self.data.startswith(b"WARC/"):
            raise zlib.error("not a WARC record")


def _candidate(piece: bytes) -> Inflater | None:
    """The member that begins here, if its header decodes and its content is a WARC record or nothing."""
    if len(piece) < 4 or piece[3] & 0xE0:  # reserved flags of the header
        return None
    try:
        return Inflater(piece)
    except zlib.error:
        return None


def members_of(pieces: Iterator[bytes]) -> Iterator[tuple[str, bytes]]:
    """('record', content) of whole members, ('orphan', bytes) before the first one, ('tail', bytes) of an unfinished last one."""
    held: Inflater | None = None
    started = False
    for piece in pieces:
        if held is not None:
            before = held.raw
            try:
                held.add(piece)
            except zlib.error:
                if started:
                    raise
                yield "orphan", before  # bytes of a member that began before this range, which only looked like a start
                held = None
        if held is None:
            held = _candidate(piece)
            if held is None:
                if started:
                    raise ValueError("bytes between the members of an archive")
                yield "orphan", piece
                continue
        started = started or held.done or len(held.data) >= 5
        if held.done:
            if held.data:
                yield "record", held.data
            held = None
    if held is not None:
        yield "tail", held.raw


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """The pieces of each byte range that this task scans, in order, each with its magic number."""
    from itertools import groupby

    def rows() -> Iterator[tuple[str, int, bytes]]:
        for batch in batches:
            yield from zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("piece").to_pylist())

    for key, group in groupby(rows(), key=lambda r: r[:2]):
        yield key, (MAGIC + r[2] for n, r in enumerate(group) if n or key[1] or r[2])


def _scan(batches: Iterator[pa.RecordBatch], wanted: str) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = 0
    for (file, block), pieces in _ranges(batches):
        for number, (kind, data) in enumerate(members_of(pieces)):
            if wanted == "records" and kind == "record":
                row = parse(data)
                if row:
                    out.append(row)
                    size += row[4]
            elif wanted == "left" and kind != "record":
                out.append((file, block, number, kind, data))
                size += len(data)
            if len(out) >= 1000 or size > 8 << 20:
                yield _rows(out, wanted)
                out, size = [], 0
    yield _rows(out, wanted)


def _rows(rows: list[tuple], wanted: str) -> pa.RecordBatch:
    names, kinds = (["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]) if wanted == "records" else (["file", "block", "number", "kind", "piece"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()])
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _mend() -> Callable[[pa.Table], pa.Table]:
    def mend(left: pa.Table) -> pa.Table:
        """Members whose pieces lie on both sides of a border, of one file."""
        pieces = left.sort_by([("block", "ascending"), ("number", "ascending")]).column("piece").to_pylist()
        rows = []
        for kind, data in members_of(iter(pieces)):
            if kind != "record":
                raise ValueError("an archive ends inside a member")
            if row := parse(data):
                rows.append(row)
        return pa.Table.from_batches([_rows(rows, "records")])

    return mend


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits) of all page records.

    Payloads are checked against their digests. Empty archives give no rows; broken ones are an error. The files' names must not
    end as compressed ones, for Spark would then inflate them whole instead of scanning ranges.
    """
    ready(spark)
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(folder)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    records = pieces.mapInArrow(partial(_scan, wanted="records"), RECORD)
    left = pieces.mapInArrow(partial(_scan, wanted="left"), LEFT)
    return records.unionByName(left.groupBy("file").applyInArrow(_mend(), RECORD))


@register("op7_warc_ranges")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    place = shared_folder(spark)
    write_archives(table(spark, folder, "pages"), place)
    return read_archives(spark, place).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
