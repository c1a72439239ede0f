"""The work queue as data: claims, retries with backoff, and the status a job history adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.skew import running_number
from docloom.settings import DEFAULTS, Settings

# Stages in order, and the document status each finished stage leaves.
STAGES = ("extract", "index", "enrich", "summarize", "delta")
STATUS_AFTER = {"extract": "EXTRACTED", "index": "INDEXED", "enrich": "ENRICHED", "summarize": "READY", "delta": "READY"}
ERROR_CHARS = 4000
REPORT_CHARS = 2000


def enqueue(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Append queued jobs; ids continue after the largest one, by document and stage, without gaps."""
    top = jobs.agg(F.coalesce(F.max("job_id"), F.lit(0)).alias("top")).scalar()
    numbered = running_number(requests, [], F.col("document_id"), [F.col("stage"), F.col("version_id")], "_n")
    fresh = numbered.select(
        (F.col("_n") + top).cast("long").alias("job_id"), "document_id", "version_id", "stage",
        F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.current_timestamp().alias("run_after"), F.lit(None).cast("string").alias("last_error"),
    )
    return jobs.unionByName(fresh, allowMissingColumns=True)


def claimable(jobs: DataFrame, now: Column, stages: list[str] | None = None) -> DataFrame:
    ready = jobs.where((F.col("status") == "queued") & (F.col("run_after") <= now))
    return ready.where(F.col("stage").isin(stages)) if stages else ready


def claim(jobs: DataFrame, now: Column, batch: int = 1, stages: list[str] | None = None) -> DataFrame:
    """The lowest-numbered ready jobs, marked running with one more attempt."""
    taken = claimable(jobs, now, stages).orderBy("job_id").limit(batch)
    return taken.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1})


def completed(running: DataFrame) -> DataFrame:
    return running.withColumns({"status": F.lit("done"), "last_error": F.lit(None).cast("string")})


def failed(running: DataFrame, error: Column, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Back to the queue after ``2 ** attempts`` seconds while attempts remain, else failed for good."""
    retry = F.col("attempts") < settings.job_max_attempts
    return running.withColumns(
        {
            "last_error": F.substring(F.substring(error, 1, REPORT_CHARS), 1, ERROR_CHARS),
            "status": F.when(retry, "queued").otherwise("failed"),
            "run_after": F.when(retry, now + F.make_dt_interval(secs=F.pow(F.lit(2.0), F.col("attempts")))).otherwise(F.col("run_after")),
        }
    )


def retry_schedule(failures: DataFrame, time: str, block: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Number the failures of each (document, stage) and give the moment each is tried again."""
    numbered = running_number(failures, ["document_id", "stage"], block, [F.col(time), F.col("job_id")], "attempt")
    retry = F.col("attempt") < settings.job_max_attempts
    seconds = F.pow(F.lit(2.0), F.least("attempt", F.lit(settings.job_max_attempts)))
    return numbered.withColumns(
        {
            "status": F.when(retry, "queued").otherwise("failed"),
            "retry_at": F.when(retry, F.col(time) + F.make_dt_interval(secs=seconds)),
        }
    )


def latest_per_stage(jobs: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Last job of each (document, stage), counting only the current version where versions are known."""
    rows = jobs
    if documents is not None:
        current = documents.select("document_id", "current_version_id")
        rows = jobs.join(current, "document_id").where(F.col("version_id").isNull() | (F.col("version_id") == F.col("current_version_id")))
    body = F.struct("job_id", "status", "updated_at")
    last = rows.groupBy("document_id", "stage").agg(F.max_by(body, F.col("job_id")).alias("last"))
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    return last.select("document_id", "stage", order.cast("int").alias("stage_order"), "last.job_id", "last.status", "last.updated_at")


def document_status(latest: DataFrame) -> DataFrame:
    """Status a document's job history adds up to.

    A stage that failed for good wins; otherwise the latest finished job names the status.
    """
    after = F.create_map(*[F.lit(v) for pair in STATUS_AFTER.items() for v in pair])
    failed_stage = F.max_by(F.when(F.col("status") == "failed", F.col("stage")), F.when(F.col("status") == "failed", F.col("job_id")))
    done_stage = F.max_by(F.when(F.col("status") == "done", F.col("stage")), F.when(F.col("status") == "done", F.col("job_id")))
    folded = latest.groupBy("document_id").agg(failed_stage.alias("failed_stage"), done_stage.alias("done_stage"))
    status = F.when(F.col("failed_stage").isNotNull(), "FAILED").otherwise(F.coalesce(F.try_element_at(after, F.col("done_stage")), F.lit("UPLOADED")))
    return folded.select("document_id", status.alias("status"), "failed_stage")


def next_stage(stage: Column, version_no: Column) -> Column:
    """What follows a finished stage; null at the end."""
    return (
        F.when((stage == "extract") & (version_no == 1), "index")
        .when(stage == "extract", "delta")
        .when(stage == "index", "enrich")
        .when(stage == "enrich", "summarize")
    )
