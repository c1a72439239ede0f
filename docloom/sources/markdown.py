"""Markdown (as page transcription returns it) into heading, table and paragraph blocks.

Lines are classified, runs of lines that belong together are found as islands, and each island is
one block. Everything is keyed by document and line number, so it is plain window and grouping work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import strip

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _row_cells(line: Column) -> Column:
    inner = F.regexp_replace(line, r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|"), strip)


def _table_row(line: Column) -> Column:
    """Cells joined by `` | ``; null for a separator row such as ``|---|:-:|``."""
    cells = _row_cells(line)
    filled = F.filter(cells, lambda c: c != "")
    separator = (F.size(filled) > 0) & F.forall(filled, lambda c: c.rlike(r"^:?-{2,}:?$"))
    return F.when(~separator, F.array_join(cells, " | "))


def markdown_blocks(pages: DataFrame, key: list[str], text: str, source: str = "ocr") -> DataFrame:
    """``(key..., order, type, level, text, source)`` blocks of each page text."""
    lines = pages.select(*key, F.posexplode(F.transform(F.split(text, LINE_BREAK), strip)).alias("pos", "line"))
    line = F.col("line")
    heading = F.regexp_extract(line, r"^(#{1,6})", 1)
    kind = (
        F.when(line == "", "blank")
        .when(line.startswith("|") & line.endswith("|") & (F.length(line) > 1), "table")
        .when(heading != "", "heading")
        .otherwise("paragraph")
    )
    by_page = Window.partitionBy(*key).orderBy("pos")
    classified = lines.withColumn("kind", kind)
    breaks = (F.col("kind") != F.coalesce(F.lag("kind").over(by_page), F.lit(""))) | F.col("kind").isin("heading", "blank")
    islands = classified.withColumn("island", F.sum(breaks.cast("int")).over(by_page)).where("kind <> 'blank'")
    body = (
        F.when(F.col("kind") == "table", _table_row(line))
        .when(F.col("kind") == "heading", strip(F.regexp_replace(strip(F.regexp_replace(line, r"^#{1,6}", "")), "#+$", "")))
        .otherwise(line)
    )
    merged = (
        islands.withColumn("body", body)
        .withColumn("level", F.when(F.col("kind") == "heading", F.length(heading)))
        .groupBy(*key, "island")
        .agg(
            F.first("kind").alias("type"),
            F.first("level").alias("level"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("pos", "body")))), lambda p: p["body"]), "\n").alias("text"),
        )
        .where(strip(F.col("text")) != "")
    )
    ordered = Window.partitionBy(*key).orderBy("island")
    return merged.select(
        *key, (F.row_number().over(ordered) - 1).alias("order"), "type", "level", "text", F.lit(source).alias("source")
    )


def blocks_by_document(blocks: DataFrame, key: str, page: Column | None = None) -> DataFrame:
    """One ``blocks`` array per document, in order."""
    entry = F.struct(
        F.col("order"), F.col("type"), F.col("text"), (page if page is not None else F.lit(1)).alias("page"),
        F.col("level"), F.lit(None).cast("double").alias("font_size"),
    )
    return blocks.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("blocks"))


def serialize_table(rows: Column) -> Column:
    """Table cells (array of rows) as ``header: value`` lines; a lone row is its cells joined."""
    cleaned = F.filter(F.transform(rows, lambda r: F.transform(r, strip)), lambda r: F.exists(r, lambda c: c != ""))
    header = F.get(cleaned, 0)

    def pairs(row: Column) -> Column:
        named = F.transform(
            row,
            lambda value, i: F.when(
                value != "",
                F.concat(F.coalesce(F.when(F.get(header, i) != "", F.get(header, i)), F.concat(F.lit("col"), (i + 1).cast("string"))), F.lit(": "), value),
            ),
        )
        return F.array_join(named, " | ")

    lines = F.filter(F.transform(F.slice(cleaned, F.lit(2), F.greatest(F.size(cleaned), F.lit(1))), pairs), lambda t: t != "")
    single = F.array_join(F.filter(header, lambda c: c != ""), " | ")
    return F.when(F.size(cleaned) == 0, "").when(F.size(cleaned) == 1, single).otherwise(F.array_join(lines, "\n"))
