"""The search index as parquet tables: passages, titles and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.catalog import replace_partition
from docloom.operators.retrieval import FIELDS, analyze_index
from docloom.operators.suggest import title_index
from docloom.sources.files import blob_store_exists

PASSAGES, TITLES, POSTINGS = "passages", "titles", "postings"


def passage_rows(documents: DataFrame, versions: DataFrame, chunks: DataFrame, nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """Searchable rows: the chunks of each current manifest and the summaries above them.

    Rows are keyed by (document_id, chunk_id), so documents sharing content never overwrite each other.
    """
    wanted = versions.select("document_id", "version_id", F.explode("chunk_manifest").alias("chunk_id"))
    columns = ["document_id", "version_id", "chunk_id", "level", "text", "heading_path", "page_from", "embedding"]
    leaves = wanted.join(chunks, ["document_id", "chunk_id"]).withColumn("level", F.lit(0)).select(columns)
    summaries = nodes.where("level >= 1").join(versions.select("document_id", "version_id"), "document_id").select(
        "document_id", "version_id", F.col("node_id").alias("chunk_id"), "level", F.col("summary_text").alias("text"),
        F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("int").alias("page_from"), "embedding",
    )
    names = tags.groupBy("document_id").agg(F.array_sort(F.collect_set("tag_name")).alias("tags"))
    shared = documents.where(F.col("deleted_at").isNull()).select(
        "document_id", "department_id", "doctype", "title", "effective_date", F.col("superseded_by").isNotNull().alias("superseded"),
        F.array("department_id").alias("allowed_groups"),
    ).join(names, "document_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return leaves.unionByName(summaries).join(shared, "document_id")


def title_rows(documents: DataFrame, tags: DataFrame) -> DataFrame:
    names = tags.groupBy("document_id").agg(F.array_sort(F.collect_set("tag_name")).alias("tags"))
    alive = documents.where(F.col("deleted_at").isNull()).select(
        "document_id", "title", "doctype", "department_id", F.array("department_id").alias("allowed_groups"), F.col("superseded_by").isNotNull().alias("superseded")
    )
    return title_index(alive.join(names, "document_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))))


def postings(analyzed: DataFrame) -> DataFrame:
    """``(field, term, chunk_id, tf, length)``, ready to be written clustered by term."""
    fields = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"terms_{name}").alias("terms")) for i, (name, _) in enumerate(FIELDS)])
    exploded = analyzed.select("chunk_id", F.explode(fields).alias("f")).select(
        "chunk_id", "f.field", F.size("f.terms").alias("length"), F.explode("f.terms").alias("term")
    )
    return exploded.groupBy("field", "term", "chunk_id", "length").agg(F.count(F.lit(1)).alias("tf"))


def write_index(rows: DataFrame, titles: DataFrame, folder: str) -> None:
    """Full rebuild: passages analysed once and laid out by department, so access filters prune folders."""
    analyze_index(rows).write.mode("overwrite").partitionBy("department_id").parquet(f"{folder}/{PASSAGES}")
    titles.write.mode("overwrite").partitionBy("department_id").parquet(f"{folder}/{TITLES}")


def read_passages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{PASSAGES}")


def read_titles(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{TITLES}")


def write_generation(passages: DataFrame, titles: DataFrame, base: str, generation: int) -> str:
    """Write a complete new generation beside the old one and return its folder.

    Readers keep the generation they opened, and an interrupted write leaves the old one whole.
    """
    folder = f"{base}/generation={generation}"
    if blob_store_exists(passages.sparkSession, folder):
        raise ValueError(f"generation {generation} exists")
    passages.write.partitionBy("department_id").parquet(f"{folder}/{PASSAGES}")
    titles.write.partitionBy("department_id").parquet(f"{folder}/{TITLES}")
    return folder


def upsert_passages(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """All passages of the documents in ``rows`` replaced by ``rows``."""
    return replace_partition(stored, rows.select(stored.columns), ["document_id"])


def delete_passages(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop by (document_id, chunk_id) or by document_id alone, whichever ``keys`` carries."""
    return stored.join(keys.distinct(), keys.columns, "left_anti")
