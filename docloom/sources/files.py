"""Binary documents: content-addressed blobs, type sniffing and extraction into blocks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.settings import DEFAULTS, Settings
from docloom.sources.markdown import blocks_by_document, markdown_blocks, serialize_table

# Supported types and their leading bytes.
PDF, PNG, JPEG = "application/pdf", "image/png", "image/jpeg"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
PNG_MAGIC = bytes.fromhex("89504E470D0A1A0A")
JPEG_MAGIC = bytes.fromhex("FFD8FF")
ZIP_MAGIC = bytes.fromhex("504B0304")
HEADING_SIZE_RATIO = 1.3


# --- blobs --------------------------------------------------------------------


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``(path, filename, sha256, size_bytes, content)``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("size_bytes"), "content",
    )


def write_blobs(files: DataFrame, folder: str) -> None:
    """Store contents not stored yet, one row per hash, under ``prefix=`` folders of the hash."""
    spark = files.sparkSession
    new = files.select("sha256", "size_bytes", "content").dropDuplicates(["sha256"])
    if blob_store_exists(spark, folder):
        new = new.join(read_blobs(spark, folder).select("sha256"), "sha256", "left_anti")
    new.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("prefix").parquet(folder)


def blob_store_exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read_blobs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def get_blob(spark: SparkSession, folder: str, sha256: str) -> bytes:
    """One blob by its hash; only that hash's folder is read. A missing one is a ``KeyError``."""
    row = read_blobs(spark, folder).where((F.col("prefix") == sha256[:2]) & (F.col("sha256") == sha256)).select("content").first()
    if row is None:
        raise KeyError(sha256)
    return bytes(row["content"])


# --- type sniffing ------------------------------------------------------------


def _office_type(content: bytes | None) -> str | None:
    if content is None:
        return None
    try:
        names = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
    except zipfile.BadZipFile:
        return None
    return DOCX if "word/document.xml" in names else XLSX if "xl/workbook.xml" in names else None


@F.pandas_udf(StringType())
def _zip_type(content: pd.Series) -> pd.Series:
    return content.map(_office_type).astype(object)


def sniff_type(content: Column) -> Column:
    """MIME type from the bytes alone; null when unsupported. Only archives are opened."""

    def starts(magic: bytes) -> Column:
        return F.substring(content, 1, len(magic)) == F.lit(magic)

    pdf = F.when(F.contains(F.substring(content, 1, 1024), F.lit(b"%PDF")), PDF)
    archive = F.when(starts(ZIP_MAGIC), content)
    zipped = F.when(archive.isNotNull(), F.coalesce(_zip_type(archive), pdf))
    return F.when(starts(PNG_MAGIC), PNG).when(starts(JPEG_MAGIC), JPEG).otherwise(F.coalesce(zipped, pdf))


# --- office formats -----------------------------------------------------------

RAW_SCHEMA = (
    "sha256 string, page int, order int, kind string, style string, text string, cells array<array<string>>, title string, pages int"
)


def _name(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text_of(element: ElementTree.Element) -> str:
    symbols = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join((e.text or "") if _name(e) == "t" else symbols.get(_name(e), "") for e in element.iter())


def _core_title(archive: zipfile.ZipFile) -> str | None:
    if "docProps/core.xml" not in archive.namelist():
        return None
    for element in ElementTree.fromstring(archive.read("docProps/core.xml")).iter():
        if _name(element) == "title":
            return (element.text or "").strip() or None
    return None


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _word_items(archive: zipfile.ZipFile) -> Iterator[tuple]:
    """(page, kind, style, text, cells) of the body's paragraphs and tables, in order."""
    styles: dict[str, str] = {}
    if "word/styles.xml" in archive.namelist():
        for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter():
            if _name(style) == "style":
                label = next((_attribute(c, "val") for c in style if _name(c) == "name"), None)
                styles[_attribute(style, "styleId") or ""] = label or ""
    body = next(e for e in ElementTree.fromstring(archive.read("word/document.xml")).iter() if _name(e) == "body")
    for element in body:
        if _name(element) == "p":
            style = next((_attribute(e, "val") or "" for e in element.iter() if _name(e) == "pStyle"), "")
            yield 1, "text", styles.get(style, style), _text_of(element).strip(), None
        elif _name(element) == "tbl":
            yield 1, "table", "", "", _word_rows(element)


def _word_rows(table: ElementTree.Element) -> list[list[str]]:
    """Cell texts by row; a cell that goes on with a vertical merge has the text of the cell above it."""
    rows: list[list[str]] = []
    above: dict[int, str] = {}  # grid column -> text of the last cell that began there
    for row in (e for e in table if _name(e) == "tr"):
        texts, column = [], 0
        for cell in (e for e in row if _name(e) == "tc"):
            marks = {_name(m): _attribute(m, "val") for p in cell if _name(p) == "tcPr" for m in p}
            goes_on = "vMerge" in marks and marks["vMerge"] != "restart"
            text = "\n".join(_text_of(p) for p in cell if _name(p) == "p")
            text = above.get(column, text) if goes_on else text
            above[column] = text
            texts.append(text)
            column += int(marks.get("gridSpan") or 1)
        rows.append(texts)
    return rows


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]*", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


#: Numbers of the built-in formats that show dates or times; 46 shows a duration.
DATE_FORMATS, DURATION_FORMAT = {*range(14, 23), 45, 46, 47}, 46
_UNSHOWN = re.compile(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.I)
_ELAPSED = re.compile(r"\[(?:h+|m+|s+)\]", re.I)


def _date_styles(archive: zipfile.ZipFile) -> dict[int, str]:
    """Cell styles whose number format shows a date ('date') or an elapsed time ('duration')."""
    if "xl/styles.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    kinds = {n: "duration" if n == DURATION_FORMAT else "date" for n in DATE_FORMATS}
    for e in root.iter():
        if _name(e) == "numFmt" and _attribute(e, "numFmtId"):
            shown = _UNSHOWN.sub("", (_attribute(e, "formatCode") or "").split(";")[0])
            kind = "duration" if _ELAPSED.search(shown) else "date" if re.search("[dmhys]", shown, re.I) else ""
            kinds[int(_attribute(e, "numFmtId") or 0)] = kind if shown.lower() != "general" else ""
    styles = next((list(e) for e in root if _name(e) == "cellXfs"), [])
    found = {i: kinds.get(int(_attribute(e, "numFmtId") or 0), "") for i, e in enumerate(styles)}
    return {i: kind for i, kind in found.items() if kind}


def _moment(days: float, kind: str, first: datetime) -> str:
    """A day count as date and time, as a time of day below one day, or as a duration."""
    span = timedelta(milliseconds=round(days * 86_400_000))
    if kind == "duration":
        return str(span)
    if 0 <= days < 1 and span.days == 0:
        return str((datetime.min + span).time())
    early = first.year == 1899 and 0 < days < 60  # the day count has a 29 February 1900
    return str(first + span + timedelta(days=int(early)))


def _sheet_items(archive: zipfile.ZipFile) -> Iterator[tuple]:
    """(page, kind, style, text, cells): one item per sheet, the sheet's name as its style."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = [_text_of(e) for e in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")) if _name(e) == "si"]
    targets = {
        _attribute(e, "Id"): _attribute(e, "Target") for e in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    }
    book = list(ElementTree.fromstring(archive.read("xl/workbook.xml")).iter())
    sheets = [e for e in book if _name(e) == "sheet"]
    late = any(_name(e) == "workbookPr" and _attribute(e, "date1904") in ("1", "true") for e in book)
    dates, first = _date_styles(archive), datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
    for page, sheet in enumerate(sheets, start=1):
        target = (targets[_attribute(sheet, "id")] or "").lstrip("/")
        rows = []
        for row in ElementTree.fromstring(archive.read(target if target.startswith("xl/") else f"xl/{target}")).iter():
            if _name(row) != "row":
                continue
            values: list[str] = []
            for cell in row:
                at = _column_number(_attribute(cell, "r") or "") if _attribute(cell, "r") else len(values)
                values.extend([""] * (at - len(values)))
                values.append(_cell_text(cell, shared, dates.get(int(_attribute(cell, "s") or 0), ""), first))
            rows.append(values)
        yield page, "sheet", _attribute(sheet, "name") or "", "", rows


def _cell_text(cell: ElementTree.Element, shared: list[str], date: str, first: datetime) -> str:
    kind = _attribute(cell, "t") or "n"
    if kind == "inlineStr":
        return _text_of(cell).strip()
    raw = next((e.text or "" for e in cell if _name(e) == "v"), "")
    if kind == "s" and raw:
        return shared[int(raw)].strip()
    if kind == "b" and raw:
        return "True" if raw == "1" else "False"
    if kind == "n" and raw:
        number = float(raw)
        if date:
            try:
                return _moment(number, date, first)
            except (OverflowError, ValueError):  # no such day: the number itself
                pass
        return str(int(number)) if number.is_integer() else str(number)
    return raw.strip()


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in RAW_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for sha, mime, content in zip(batch["sha256"], batch["mime"], batch["content"]):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
                title = _core_title(archive)
                items = list(_word_items(archive) if mime == DOCX else _sheet_items(archive))
            except Exception as error:  # whatever a broken file causes concerns that file alone
                title, items = None, [(1, "error", "", f"{type(error).__name__}: {error}", None)]
            pages = 1 if mime == DOCX else len(items)
            rows += [(sha, page, i, kind, style, text, cells, title, pages) for i, (page, kind, style, text, cells) in enumerate(items)]
        yield pd.DataFrame(rows, columns=columns)


def _word_blocks(raw: DataFrame) -> DataFrame:
    style = F.lower(F.trim("style"))
    number = F.regexp_extract(style, r"^heading\s*(\d+)$", 1).try_cast("int")
    level = F.when(style == "title", 1).when(number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(6), number)))
    return raw.where("kind <> 'sheet'").select(
        "sha256", "page", F.array(F.col("order")).alias("place"),
        F.when(F.col("kind").isin("table", "error"), F.col("kind")).when(level.isNotNull(), "heading").otherwise("paragraph").alias("type"),
        F.when(F.col("kind") == "text", level).alias("level"),
        F.when(F.col("kind") == "table", serialize_table(F.col("cells"))).otherwise(F.col("text")).alias("text"),
        F.lit("docx").alias("source"),
    )


def _sheet_blocks(raw: DataFrame) -> DataFrame:
    """Leading one-cell rows are title and notes, the next row is the header, each later row a table block."""
    filled = F.filter(F.col("cells"), lambda r: F.exists(r, lambda c: c != ""))
    wide = F.filter(F.transform("rows", lambda r, i: F.when(F.size(F.filter(r, lambda c: c != "")) != 1, i)), lambda i: i.isNotNull())
    sheets = (
        raw.where("kind = 'sheet'")
        .withColumn("rows", filled)
        .withColumn("leading", F.coalesce(F.get(wide, 0), F.size("rows")))
        .withColumn("leading", F.when((F.col("leading") == F.size("rows")) & (F.size("rows") > 1), 0).otherwise(F.col("leading")))
        .withColumn("lead", F.transform(F.slice("rows", F.lit(1), F.col("leading")), lambda r: F.filter(r, lambda c: c != "")[0]))
    )
    header = F.get(F.col("rows"), F.col("leading"))

    def block(kind: str, level: int | None, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(level).cast("int").alias("level"), text.alias("text"))

    name = F.col("style")
    titled = F.concat(
        F.array(block("heading", 1, F.get(F.col("lead"), 0))),
        F.when((F.trim(name) != "") & (F.trim(name) != F.get(F.col("lead"), 0)), F.array(block("heading", 2, name))).otherwise(F.array_remove(F.array(block("heading", 2, name)), block("heading", 2, name))),
        F.transform(F.slice(F.col("lead"), F.lit(2), F.greatest(F.col("leading"), F.lit(1))), lambda t: block("paragraph", None, t)),
    )
    start = F.when(F.col("leading") > 0, titled).otherwise(F.array(block("heading", 1, name)))
    data = F.transform(
        F.slice(F.col("rows"), F.col("leading") + 2, F.size("rows") + 1), lambda r: block("table", None, serialize_table(F.array(header, r)))
    )
    return (
        sheets.select("sha256", "page", "order", F.posexplode(F.concat(start, data)).alias("inner", "b"))
        .select("sha256", "page", F.array("order", "inner").alias("place"), "b.type", "b.level", "b.text", F.lit("xlsx").alias("source"))
    )


def extract_office(files: DataFrame) -> DataFrame:
    """Blocks of DOCX and XLSX files: ``(sha256, page, order, type, level, text, source, title, pages)``.

    Opening the archive is the only Python step; headings, tables and numbering are column expressions. A file that
    can't be read has one row of type ``error`` whose text says why; the other files are not concerned.
    """
    packed = files.withColumn("mime", sniff_type(F.col("content"))).where(F.col("mime").isin(DOCX, XLSX))
    raw = packed.select("sha256", "mime", "content").mapInPandas(_unpack, RAW_SCHEMA)
    facts = raw.groupBy("sha256").agg(F.first("title").alias("title"), F.max("pages").alias("pages"))
    blocks = _word_blocks(raw).unionByName(_sheet_blocks(raw)).where(F.col("text") != "")
    grouped = blocks.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("place", "page", "type", "level", "text", "source"))).alias("b"))
    numbered = grouped.select("sha256", F.posexplode("b").alias("order", "b"))
    return numbered.select("sha256", "b.page", "order", "b.type", "b.level", "b.text", "b.source").join(facts, "sha256")


# --- page-oriented formats ------------------------------------------------------


def classify_pdf_blocks(spans: DataFrame, settings: Settings = DEFAULTS, transcribed: bool = True) -> DataFrame:
    """Headings of a PDF text layer from print sizes.

    ``spans`` is ``(doc, page, block, text, size)``, the output of whatever reads the PDF. A block takes
    the size most of its characters have; a heading is at least 1.3 times the document's
    character-weighted median size, level 1 for the largest such size only. Pages with fewer than
    ``ocr_text_threshold`` characters are left to transcription; without a transcriber (``transcribed=False``) they are kept.
    """
    sized = spans.groupBy("doc", "page", "block", F.round("size", 1).alias("size")).agg(
        F.sum(F.length(F.trim("text"))).alias("chars"), F.min("line").alias("line")
    )
    dominant = sized.where("chars > 0").groupBy("doc", "page", "block").agg(F.max_by("size", F.struct("chars", -F.col("line"))).alias("size"))
    texts = spans.groupBy("doc", "page", "block").agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: F.trim(s["text"])), "\n")).alias("text")
    )
    blocks = texts.join(dominant, ["doc", "page", "block"]).where("text <> ''")
    page_length = texts.groupBy("doc", "page").agg(F.sum(F.length("text")).alias("page_chars"))
    kept = blocks.join(page_length, ["doc", "page"]).where((F.col("page_chars") >= settings.ocr_text_threshold) | F.lit(not transcribed))
    body = kept.groupBy("doc").agg(F.percentile("size", F.lit(0.5), F.greatest(F.lit(1), F.length("text"))).alias("body"))
    marked = kept.join(body, "doc").withColumn("heading", (F.col("body") > 0) & (F.col("size") >= F.col("body") * HEADING_SIZE_RATIO))
    largest = marked.where("heading").groupBy("doc").agg(F.max("size").alias("largest"))
    return marked.join(largest, "doc", "left").select(
        "doc", "page", "block", F.when(F.col("heading"), "heading").otherwise("paragraph").alias("type"),
        F.when(F.col("heading"), F.when(F.col("size") == F.col("largest"), 1).otherwise(2)).alias("level"),
        F.when(F.col("heading"), F.regexp_replace("text", r"\s+", " ")).otherwise(F.col("text")).alias("text"),
        F.col("size").alias("font_size"),
    )


def pages_for_transcription(spans: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pages whose text layer is too short to trust."""
    chars = spans.groupBy("doc", "page").agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    return chars.where(F.col("chars") < settings.ocr_text_threshold).select("doc", "page")


def extract_images(files: DataFrame, transcribe: Callable[[Column], Column] | None) -> DataFrame:
    """Images through a transcription port (``Column[binary] -> Column[markdown]``); without one, no blocks."""
    images = files.where(sniff_type(F.col("content")).isin(PNG, JPEG))
    if transcribe is None:
        return images.limit(0).select("sha256", F.lit(0).alias("order"), F.lit("").alias("type"), F.lit(0).alias("level"), F.lit("").alias("text"), F.lit("").alias("source"))
    return markdown_blocks(images.select("sha256", transcribe(F.col("content")).alias("text")), ["sha256"], "text")


def extract(files: DataFrame, transcribe: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per supported file with its block array, page count and embedded title, or why it could not be read (``error``)."""
    mime = files.select("sha256", "filename", sniff_type(F.col("content")).alias("mime_type"))
    office = extract_office(files)
    failed = F.max(F.when(F.col("type") == "error", F.col("text"))).alias("error")
    facts = office.groupBy("sha256").agg(F.first("title").alias("embedded_title"), F.max("pages").alias("page_count"), failed)
    columns = ["sha256", "page", "order", "type", "level", "text", "source"]
    images = extract_images(files, transcribe).withColumn("page", F.lit(1))
    blocks = office.where("type <> 'error'").select(columns).unionByName(images.select(columns))
    arrays = blocks_by_document(blocks, "sha256", F.col("page"))
    return mime.join(arrays, "sha256", "left").join(facts, "sha256", "left")
