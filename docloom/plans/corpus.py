"""Document-domain views derived from the given tables, each with its SQL twin.

Every view keeps all rows of the table it reads. The SQL twins are common table expressions the
checker's engine can run on the same parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.vectors import hash_embedder
from docloom.session import shared_folder
from docloom.sources import inverted, title_store
from docloom.sources.files import blob_store_exists
from docloom.sources.tables import spread, table

# The caller used by the registered queries: a member of ten of the twenty departments.
GROUPS = [f"src{i}" for i in range(10)]
VECTOR_DIM = 256


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document with the metadata the table itself does not carry, derived from its key."""
    d = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in ("policy", "sop", "circular", "guideline", "report", "minutes", "other")])
    first_line = F.trim(F.get(F.split("text", "\n"), 0))
    return spread(table(spark, folder, "documents")).select(
        d.alias("document_id"),
        F.col("source").alias("department_id"),
        F.col("lang").alias("language"),
        F.when(first_line == "", F.lit("Untitled document")).otherwise(first_line).alias("title"),
        F.element_at(kinds, (F.pmod(d, F.lit(7)) + 1).cast("int")).alias("doctype"),
        F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(d, F.lit(1000)).cast("int")).cast("string").alias("effective_date"),
        F.when(F.pmod(d, F.lit(5)) == 0, d + 1).alias("superseded_by"),
        F.when(F.pmod(d, F.lit(17)) == 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"),
        F.element_at(F.array(*[F.lit(s) for s in ("READY", "READY", "INDEXED", "FAILED")]), (F.pmod(d, F.lit(4)) + 1).cast("int")).alias("status"),
        F.lit(None).cast("string").alias("root_summary"),
        "text",
    )


CATALOGUE_SQL = """
cat AS (
  SELECT doc_id AS document_id, source AS department_id, lang AS language,
    CASE WHEN trim(split_part(text, chr(10), 1)) = '' THEN 'Untitled document'
         ELSE trim(split_part(text, chr(10), 1)) END AS title,
    (['policy','sop','circular','guideline','report','minutes','other'])[doc_id % 7 + 1] AS doctype,
    CAST(DATE '2023-01-01' + CAST(doc_id % 1000 AS INTEGER) AS VARCHAR) AS effective_date,
    CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 END AS superseded_by,
    CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-01-01' END AS deleted_at,
    (['READY','READY','INDEXED','FAILED'])[doc_id % 4 + 1] AS status, text
  FROM documents)
"""

GROUPS_SQL = "(" + ", ".join(f"'{g}'" for g in GROUPS) + ")"


def document_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Links from quality labels and language: a document has one or two tags."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("tag_name"))
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, F.lit("Good")).otherwise(F.lit("Poor")).alias("tag_name")
    )
    return docs.unionByName(labels)


DOCUMENT_TAGS_SQL = """
doc_tags AS (
  SELECT doc_id AS document_id, lang AS tag_name FROM documents
  UNION ALL
  SELECT doc_id, CASE WHEN quality = 1 THEN 'Good' ELSE 'Poor' END FROM labels)
"""


def search_index(spark: SparkSession, folder: str, dim: int = VECTOR_DIM) -> DataFrame:
    """Whole documents as single passages of the search index."""
    cat = catalogue(spark, folder)
    return cat.select(
        F.col("document_id").alias("chunk_id"),
        "document_id",
        F.lit(0).alias("level"),
        F.array("department_id").alias("allowed_groups"),
        "department_id", "doctype", "title", "text", "effective_date",
        F.array().cast("array<string>").alias("heading_path"),
        F.lit(1).alias("page_from"),
        F.col("superseded_by").isNotNull().alias("superseded"),
        hash_embedder(dim)("text").alias("embedding"),
    )


_BUILT: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, folder: str, name: str, last: str, write: Callable[[str], None]) -> str:
    """The folder of an index, written once for each session and folder of tables; last is the table written last."""
    key = (spark.sparkContext.applicationId, folder, name)
    place = _BUILT.get(key)
    if place is None or not blob_store_exists(spark, f"{place}/{last}/_SUCCESS"):
        place = f"{shared_folder(spark)}/{name}"
        write(place)
        _BUILT[key] = place
    return place


def stored_index(spark: SparkSession, folder: str) -> str:
    """The inverted index over all documents."""
    return _stored(spark, folder, "inverted", "terms", lambda place: inverted.build(search_index(spark, folder).drop("embedding"), place))


def stored_titles(spark: SparkSession, folder: str) -> str:
    """The index of all live titles."""
    return _stored(spark, folder, "titles", "places", lambda place: title_store.build(catalogue(spark, folder).where(F.col("deleted_at").isNull()), place))


def benchmark_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
