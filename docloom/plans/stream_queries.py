"""Registered queries that run as streams over the given tables, compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators.jobs import STAGES
from docloom.plans.registry import register
from docloom.session import shared_folder
from docloom.streaming.ingest import read_stream, start_first_arrivals, start_indexing, start_table
from docloom.streaming.jobs import job_transitions
from docloom.streaming.machine import start_machine
from docloom.settings import Settings


def _source(spark, folder, name):
    """A table as a stream of its files; a table of one file is a file of its folder."""
    place = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(place).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return read_stream(spark, place, schema)
    return read_stream(spark, folder, schema, f"{name}.parquet")


def _finish(spark, query, folder):
    query.awaitTermination()
    return spark.read.parquet(folder)


@register("stream_first_arrivals", "SELECT sha256(text) AS sha256, count(DISTINCT sha256(text)) AS kept FROM documents GROUP BY ALL")
def stream_first_arrivals(spark, folder):
    """Incremental upload check: one document per content gets through."""
    out = shared_folder(spark)
    stream = _source(spark, folder, "documents").select("doc_id", "text")
    kept = _finish(spark, start_first_arrivals(stream, "text", "doc_id", f"{out}/seen", f"{out}/checkpoint"), f"{out}/seen/kept")
    return kept.groupBy("sha256").agg(F.count(F.lit(1)).alias("kept"))


@register(
    "stream_job_states",
    """
WITH jobs AS (
  SELECT event_id AS job_id, user_id AS document_id, (['extract','index','enrich','summarize','delta'])[event_id % 5 + 1] AS stage,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, ts FROM events),
n AS (SELECT *, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, stage ORDER BY ts, job_id) AS attempt FROM jobs)
SELECT document_id, stage, job_id, CAST(attempt AS INTEGER) AS attempt, CASE WHEN status = 'failed' AND attempt < 3 THEN 'queued' ELSE status END AS status,
  CASE WHEN status = 'failed' AND attempt < 3 THEN ts + to_seconds(CAST(pow(2, attempt) AS INTEGER)) END AS retry_at FROM n
""",
)
def stream_job_states(spark, folder):
    out = shared_folder(spark)
    stages = F.array(*[F.lit(s) for s in STAGES])
    outcomes = _source(spark, folder, "events").select(
        F.col("user_id").alias("document_id"), F.element_at(stages, (F.pmod("event_id", F.lit(5)) + 1).cast("int")).alias("stage"),
        F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), F.col("ts").alias("updated_at"),
    )
    return _finish(spark, start_table(job_transitions(outcomes), f"{out}/table", f"{out}/checkpoint"), f"{out}/table")


@register(
    "stream_stage_machine",
    """
WITH RECURSIVE outcomes AS (
  SELECT user_id AS document_id, event_id AS job_id, event_id % 2 + 1 AS version_no, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status,
    ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
fold AS (
  SELECT DISTINCT document_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS job_id, CAST(NULL AS VARCHAR) AS stage, 0 AS attempt, CAST(NULL AS VARCHAR) AS status,
    CAST(NULL AS TIMESTAMP) AS moved_at, CAST(NULL AS TIMESTAMP) AS due, CAST(NULL AS VARCHAR) AS following, 'extract' AS now, 0 AS failures, CAST(NULL AS TIMESTAMP) AS again
  FROM outcomes
  UNION ALL
  SELECT document_id, n, job_id, stage, attempt, status, moved_at, due, following,
    CASE status WHEN 'done' THEN coalesce(following, 'extract') WHEN 'failed' THEN 'extract' ELSE stage END,
    CASE WHEN status IN ('done', 'failed') THEN 0 ELSE attempt END, CASE status WHEN 'waiting' THEN due WHEN 'ignored' THEN again END
  FROM (
    SELECT *, CASE WHEN status = 'waiting' THEN moved_at + to_seconds(CAST(pow(2, attempt) AS INTEGER)) END AS due,
      CASE WHEN status <> 'done' THEN NULL WHEN stage = 'extract' AND version_no = 1 THEN 'index' WHEN stage = 'extract' THEN 'delta'
        WHEN stage = 'index' THEN 'enrich' WHEN stage = 'enrich' THEN 'summarize' END AS following
    FROM (
      SELECT o.document_id, o.n, o.job_id, o.version_no, f.now AS stage, o.ts AS moved_at, f.again,
        CASE WHEN f.again > o.ts OR o.status = 'done' THEN f.failures ELSE f.failures + 1 END AS attempt,
        CASE WHEN f.again > o.ts THEN 'ignored' WHEN o.status = 'done' THEN 'done' WHEN f.failures + 1 < 3 THEN 'waiting' ELSE 'failed' END AS status
      FROM fold f JOIN outcomes o ON o.document_id = f.document_id AND o.n = f.n + 1)))
SELECT document_id, job_id, stage, attempt, status,
  CASE status WHEN 'failed' THEN 'FAILED' WHEN 'done' THEN CASE stage WHEN 'extract' THEN 'EXTRACTED' WHEN 'index' THEN 'INDEXED' WHEN 'enrich' THEN 'ENRICHED' ELSE 'READY' END END AS document_status, moved_at, due
FROM fold WHERE n > 0
UNION ALL SELECT document_id, job_id, following, 0, 'queued', NULL, moved_at, NULL FROM fold WHERE status = 'done' AND following IS NOT NULL
UNION ALL SELECT document_id, job_id, stage, attempt, 'queued', NULL, due, NULL FROM fold WHERE status = 'waiting' AND due < (SELECT date_trunc('milliseconds', max(ts)) FROM events)
""",
)
def stream_stage_machine(spark, folder):
    """Events as outcomes of each document's current job: stages hand over, failed jobs come back by timers."""
    out = shared_folder(spark)
    outcomes = _source(spark, folder, "events").select(
        F.col("user_id").alias("document_id"), (F.pmod("event_id", F.lit(2)) + 1).cast("int").alias("version_no"), F.col("event_id").alias("job_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), F.col("ts").alias("updated_at"),
    )
    moved = _finish(spark, start_machine(outcomes, f"{out}/table", f"{out}/checkpoint"), f"{out}/table")
    return moved.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("moved_at", "due")})


@register("stream_indexing")
def stream_indexing(spark, folder):
    """Documents chunked and embedded as they arrive; tests compare the table with the batch result."""
    out = shared_folder(spark)
    stream = _source(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), "text")
    start_indexing(stream, f"{out}/index", f"{out}/checkpoint", settings=Settings(embed_dim=64)).awaitTermination()
    return spark.read.parquet(f"{out}/index").select("document_id", "chunk_id", "ord", "token_count")
