import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.sources import files
from docloom.sources.markdown import markdown_blocks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def docx():
    def para(text, style=None):
        props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"

    def row(*cells):
        return "<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in cells) + "</w:tr>"

    table = "<w:tbl>" + row("Item", "", "Cost") + row("Pen", "blue", "2") + row("Ink", "", "") + "</w:tbl>"
    lone = "<w:tbl>" + row("only", "", "row") + "</w:tbl>"
    body = para("My Title", "T1") + para("Scope", "H9") + para("  Body text. ") + para(" ") + table + lone
    styles = '<w:style w:styleId="T1"><w:name w:val="Title"/></w:style><w:style w:styleId="H9"><w:name w:val="heading 9"/></w:style>'
    core = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title> Embedded </dc:title></cp:coreProperties>'
    return archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>", "docProps/core.xml": core})


def xlsx():
    def cell(ref, value, kind="inlineStr"):
        return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>' if kind == "inlineStr" else f'<c r="{ref}"><v>{value}</v></c>'

    lead = f'<row r="1">{cell("A1", "Budget 2026")}</row><row r="2">{cell("A2", "in thousands")}</row>'
    head = f'<row r="4">{cell("A4", "Unit")}{cell("C4", "Spend")}</row>'
    data = f'<row r="5">{cell("A5", "HR")}{cell("B5", 7.0, "n")}{cell("C5", 12.5, "n")}</row>'
    single = f'<row r="1">{cell("A1", "one")}</row><row r="2">{cell("A2", "two")}</row>'
    rels = '<Relationships xmlns="r"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>'
    book = f'<workbook {S} xmlns:r="rel"><sheets><sheet name="Plan" r:id="r1"/><sheet name="Names" r:id="r2"/></sheets></workbook>'
    sheet = lambda rows: f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>"
    return archive({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/s1.xml": sheet(lead + head + data), "xl/worksheets/s2.xml": sheet(single)})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    contents = {
        "a.docx": docx(), "wrong-name.pdf": xlsx(), "scan.png": files.PNG_MAGIC + b"png", "photo.jpg": files.JPEG_MAGIC + b"jpeg",
        "paper.bin": b"junk %PDF-1.7 ...", "notes.txt": b"plain text", "broken.zip": files.ZIP_MAGIC + b"broken", "copy.docx": docx(),
    }
    for name, data in contents.items():
        (path / name).write_bytes(data)
    return str(path)


def test_types_come_from_bytes(spark, folder):
    found = files.read_files(spark, folder).select("filename", files.sniff_type(F.col("content")).alias("t")).collect()
    assert {r["filename"]: r["t"] for r in found} == {
        "a.docx": files.DOCX, "copy.docx": files.DOCX, "wrong-name.pdf": files.XLSX, "scan.png": files.PNG, "photo.jpg": files.JPEG,
        "paper.bin": files.PDF, "notes.txt": None, "broken.zip": None,
    }


def test_office_blocks(spark, folder):
    some = files.read_files(spark, folder).where("filename IN ('a.docx', 'wrong-name.pdf')")
    names = {r["sha256"]: r["filename"] for r in some.collect()}
    made = {}
    for r in files.extract_office(some).orderBy("order").collect():
        made.setdefault(names[r["sha256"]], []).append((r["page"], r["type"], r["level"], r["text"], r["title"], r["pages"]))
    assert [b[:4] for b in made["a.docx"]] == [
        (1, "heading", 1, "My Title"), (1, "heading", 6, "Scope"), (1, "paragraph", None, "Body text."),
        (1, "table", None, "Item: Pen | col2: blue | Cost: 2\nItem: Ink"), (1, "table", None, "only | row"),
    ]
    assert made["a.docx"][0][4:] == ("Embedded", 1)
    assert [b[:4] for b in made["wrong-name.pdf"]] == [
        (1, "heading", 1, "Budget 2026"), (1, "heading", 2, "Plan"), (1, "paragraph", None, "in thousands"),
        (1, "table", None, "Unit: HR | col2: 7 | Spend: 12.5"), (2, "heading", 1, "Names"), (2, "table", None, "one: two"),
    ]
    assert made["wrong-name.pdf"][0][5] == 2


def test_images_need_a_transcriber(spark, folder):
    some = files.read_files(spark, folder).where("filename IN ('scan.png', 'a.docx')").dropDuplicates(["sha256"])
    silent = {r["filename"]: r for r in files.extract(some).collect()}
    assert silent["scan.png"]["blocks"] is None and len(silent["a.docx"]["blocks"]) == 5
    read = files.extract(some, lambda content: F.lit("# Page\n\ntext")).where("filename = 'scan.png'").first()
    assert [(b["type"], b["text"]) for b in read["blocks"]] == [("heading", "Page"), ("paragraph", "text")]


def test_blob_store(spark, folder, tmp_path):
    store = str(tmp_path / "blobs")
    everything = files.read_files(spark, folder)
    files.write_blobs(everything, store)
    files.write_blobs(everything, store)
    assert files.read_blobs(spark, store).count() == 7
    row = everything.where("filename = 'notes.txt'").first()
    assert files.get_blob(spark, store, row["sha256"]) == b"plain text"
    with pytest.raises(KeyError):
        files.get_blob(spark, store, row["sha256"][:2] + "0" * 62)


def test_markdown(spark):
    page = "# Title #\nfirst\nsecond\n\n| a | b |\n|---|:--:|\n| 1 | 2 |\ntail\n####\n## \n###Deep"
    made = markdown_blocks(spark.createDataFrame([(1, page)], "k int, text string"), ["k"], "text").orderBy("order").collect()
    assert [(r["type"], r["level"], r["text"]) for r in made] == [
        ("heading", 1, "Title"), ("paragraph", None, "first\nsecond"), ("table", None, "a | b\n1 | 2"), ("paragraph", None, "tail"), ("heading", 3, "Deep"),
    ]


def test_pdf_headings(spark):
    spans = [(1, 1, 0, 0, "Report", 24.0), (1, 1, 1, 0, "Part", 16.0), (1, 1, 2, 0, "body " * 40, 10.0), (1, 1, 2, 1, "more", 11.0), (1, 2, 0, 0, "short", 10.0)]
    df = spark.createDataFrame(spans, "doc int, page int, block int, line int, text string, size double")
    made = files.classify_pdf_blocks(df).orderBy("page", "block").collect()
    assert [(r["page"], r["type"], r["level"]) for r in made] == [(1, "heading", 1), (1, "heading", 2), (1, "paragraph", None)]
    assert [tuple(r) for r in files.pages_for_transcription(df).collect()] == [(1, 2)]


def test_merged_cells_dates_and_broken_files(spark):
    def cell(text, marks=""):
        return f"<w:tc><w:tcPr>{marks}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"

    rows = [
        cell("Unit") + cell("Both", '<w:gridSpan w:val="2"/>') + cell("Note"),
        cell("HR", '<w:vMerge w:val="restart"/>') + cell("1") + cell("2") + cell("x", '<w:vMerge w:val="restart"/>'),
        cell("", "<w:vMerge/>") + cell("wide", '<w:gridSpan w:val="2"/>') + cell("", "<w:vMerge/>"),
    ]
    table = "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"
    word = archive({"word/document.xml": f"<w:document {W}><w:body>{table}</w:body></w:document>"})
    numbers = [("A", 1, 45296), ("B", 1, 45296.5), ("C", 2, 1.25), ("D", 0, 45296), ("E", 3, 45296), ("F", 1, 0.25), ("G", 1, 1e12), ("H", 1, 59)]
    data = "".join(f'<c r="{c}2" s="{s}"><v>{v}</v></c>' for c, s, v in numbers)
    head = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{c.lower()}</t></is></c>' for c, _, _ in numbers)
    styles = '<numFmts><numFmt numFmtId="170" formatCode="[h]:mm"/><numFmt numFmtId="171" formatCode="[Red]0 &quot;days&quot;"/></numFmts>'
    styles += '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    sheet = {
        "xl/workbook.xml": f'<workbook {S} xmlns:r="rel"><sheets><sheet name="P" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="r"><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>',
        "xl/worksheets/s1.xml": f'<worksheet {S}><sheetData><row r="1">{head}</row><row r="2">{data}</row></sheetData></worksheet>',
    }
    broken = archive({"word/document.xml": "<w:document"})
    contents = [("a", "a.docx", word), ("b", "b.xlsx", archive({**sheet, "xl/styles.xml": f"<styleSheet {S}>{styles}</styleSheet>"})), ("c", "c.docx", broken)]
    df = spark.createDataFrame([(k, n, bytearray(c)) for k, n, c in contents], "sha256 string, filename string, content binary")
    made = {r["sha256"]: r for r in files.extract(df).collect()}
    assert [b["text"] for b in made["a"]["blocks"]] == ["Unit: HR | Both: 1 | Note: 2 | col4: x\nUnit: HR | Both: wide | Note: x"]
    assert [b["text"] for b in made["b"]["blocks"]] == [
        "P", "a: 2024-01-05 00:00:00 | b: 2024-01-05 12:00:00 | c: 1 day, 6:00:00 | d: 45296 | e: 45296 | f: 06:00:00 | g: 1000000000000 | h: 1900-02-28 00:00:00",
    ]
    assert made["a"]["error"] is None and made["c"]["blocks"] is None and made["c"]["error"].startswith("ParseError")
