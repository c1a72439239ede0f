"""Continuous ingestion: first arrivals, and documents chunked and embedded into the index as they come."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docloom.functions.vectors import hash_embedder
from docloom.operators.chunking import chunk_documents, line_blocks
from docloom.session import cut_lineage
from docloom.settings import DEFAULTS, Settings
from docloom.sources.files import blob_store_exists


def read_stream(spark: SparkSession, path: str, schema: StructType, files: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files appearing in ``path``, optionally only those whose name matches ``files``."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def first_arrivals(stream: DataFrame, content: Column, time: str | None = None, delay: str | None = None) -> DataFrame:
    """Rows whose content has not come before.

    State holds one hash per content. With an event time and a delay, hashes older than the watermark
    are forgotten, which bounds the state.
    """
    hashed = stream.withColumn("sha256", F.sha2(content.cast("binary"), 256))
    if time and delay:
        return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha256"])
    return hashed.dropDuplicates(["sha256"])


OPEN_BATCHES = 32  # batches of hashes kept by themselves before they are merged into one closed table
PREFIXES = 256


def _known(spark: SparkSession, folder: str, batch_id: int, prefixes: list[str]) -> DataFrame | None:
    """Stored hashes of the batches before this one, those of some prefixes only: the newest closed table and the open batches after it."""
    closed = [n for n in _numbers(spark, f"{folder}/closed") if n < batch_id]
    last = max(closed, default=-1)
    places = [f"{folder}/closed/{last}"] if closed else []
    places += [f"{folder}/open/{n}" for n in _numbers(spark, f"{folder}/open") if last < n < batch_id]
    if not places:
        return None
    tables = [spark.read.schema("sha256 string, prefix string").parquet(place) for place in places]
    return reduce(DataFrame.unionByName, tables).where(F.col("prefix").isin(prefixes))


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished tables in a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(n) for n in found if n.isdigit() and blob_store_exists(spark, f"{folder}/{n}/_SUCCESS"))


def start_first_arrivals(stream: DataFrame, content: str, row_id: str, folder: str, checkpoint: str, open_batches: int = OPEN_BATCHES) -> StreamingQuery:
    """Append the rows whose content has not come before to ``folder/kept``; a null content is an empty one.

    The stream itself keeps no state. Hashes seen so far are a table below ``folder``, parted by the first two hex digits: a batch
    reads the hashes of the prefixes it holds and appends its new ones as one open table; every ``open_batches`` batches the open tables and the closed
    one before them are merged into a new closed one. Of equal contents in a batch the row with the smallest id stays. All tables carry the number of their batch and
    are overwritten when it is replayed, and a batch reads only earlier ones, so a restart neither loses nor repeats a row.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("sha256", F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256))
        first = cut_lineage(hashed.groupBy("sha256").agg(F.min(row_id).alias("_first")).withColumn("prefix", F.substring("sha256", 1, 2)))
        prefixes = [r[0] for r in first.select("prefix").distinct().collect()]  # at most PREFIXES
        known = _known(spark, folder, batch_id, prefixes)
        fresh = first if known is None else first.join(known, ["prefix", "sha256"], "left_anti")
        fresh.repartition("prefix").select("sha256", "_first", "prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{folder}/open/{batch_id}")
        new = spark.read.schema(first.schema).parquet(f"{folder}/open/{batch_id}").select("sha256", "_first")
        kept = hashed.join(new, (hashed["sha256"] == new["sha256"]) & hashed[row_id].eqNullSafe(new["_first"]), "left_semi")
        kept.dropDuplicates(["sha256"]).write.mode("overwrite").parquet(f"{folder}/kept/batch={batch_id}")
        if (batch_id + 1) % open_batches == 0:
            every = _known(spark, folder, batch_id + 1, [f"{n:02x}" for n in range(PREFIXES)])
            every.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{folder}/closed/{batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_table(stream: DataFrame, folder: str, checkpoint: str, output_mode: str = "append") -> StreamingQuery:
    """Append the stream to a parquet table, taking everything available now."""
    return (
        stream.writeStream.format("parquet").outputMode(output_mode).option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def start_indexing(
    stream: DataFrame, folder: str, checkpoint: str, embed: Callable[[Column], Column] | None = None, settings: Settings = DEFAULTS
) -> StreamingQuery:
    """Chunk and embed each arriving ``(document_id, text)`` into ``folder``.

    Every micro-batch writes its own subfolder and overwrites it when replayed, so a restart neither
    loses nor repeats chunks.
    """
    port = embed or hash_embedder(settings.embed_dim)

    def write(batch: DataFrame, batch_id: int) -> None:
        blocks = batch.select("document_id", line_blocks(F.col("text")).alias("blocks"))
        chunks = chunk_documents(blocks, settings=settings).withColumn("embedding", port(F.col("text")))
        chunks.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
