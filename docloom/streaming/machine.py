"""The stage machine of documents, with timers that bring failed jobs back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from docloom.operators.jobs import STATUS_AFTER
from docloom.settings import DEFAULTS, Settings
from docloom.streaming.ingest import start_table

OUTPUT = "document_id bigint, job_id bigint, stage string, attempt int, status string, document_status string, moved_at bigint, due bigint"
STATE = "stage string, attempts int, job_id bigint, due bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000  # times are counted in microseconds


def following(stage: str, version_no: int | None) -> str | None:
    """The stage after a finished one; a version after the first goes the short way."""
    if stage == "extract":
        return "index" if version_no in (None, 1) else "delta"
    return {"index": "enrich", "enrich": "summarize"}.get(stage)


class StageMachine(StatefulProcessor):
    """A document's stage, its failures in it, and when it may be tried again; nothing once the document is through or given up."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", STATE)

    def _load(self) -> tuple:
        return tuple(self.place.get()) if self.place.exists() else ("extract", 0, None, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stage, attempts, waiting_job, due = self._load()
        set_before = due
        for row in sorted(rows, key=lambda r: (r.at, r.job_id is not None, r.job_id)):
            if due is not None and due <= row.at:
                yield self._row(key, waiting_job, stage, attempts, "queued", None, due)
                due = None
            if due is not None or row.status not in ("done", "failed"):
                yield self._row(key, row.job_id, stage, attempts, "ignored", None, row.at)
            elif row.status == "done":
                yield self._row(key, row.job_id, stage, attempts, "done", STATUS_AFTER[stage], row.at)
                stage, attempts = following(stage, row.version_no), 0
                if stage:
                    yield self._row(key, row.job_id, stage, 0, "queued", None, row.at)
            elif attempts + 1 < self.most:
                attempts += 1
                due, waiting_job = row.at + 2**attempts * SECOND, row.job_id
                yield self._row(key, row.job_id, stage, attempts, "waiting", None, row.at, due)
            else:
                yield self._row(key, row.job_id, stage, attempts + 1, "failed", "FAILED", row.at)
                stage, attempts = None, 0
            stage = stage or "extract"
        if due != set_before:
            if set_before is not None:
                self.handle.deleteTimer(_timer(set_before))
            if due is not None:
                self.handle.registerTimer(_timer(due))
        self._keep(stage, attempts, waiting_job, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stage, attempts, job, due = self._load()
        if due is not None and _timer(due) <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._row(key, job, stage, attempts, "queued", None, due)
            self._keep(stage, attempts, None, None)

    def _keep(self, stage: str, attempts: int, job: int | None, due: int | None) -> None:
        if stage == "extract" and not attempts:
            self.place.clear()
        else:
            self.place.update((stage, attempts, job if due is not None else None, due))

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, job, stage, attempt, status, document_status, at, due=None) -> Row:
        return Row(document_id=key[0], job_id=job, stage=stage, attempt=attempt, status=status, document_status=document_status, moved_at=at, due=due)


def _timer(due: int) -> int:
    """Milliseconds of a moment, rounded up, so that a timer never rings early."""
    return -(-due // 1000)


def stage_machine(outcomes: DataFrame, delay: str = "0 seconds", settings: Settings = DEFAULTS) -> DataFrame:
    """``(document_id, version_no, job_id, status, updated_at)`` outcomes to the transitions they cause.

    A document begins at extract. A job that is done hands over to the next stage at once (queued, attempt 0), until the document
    is through. A failed one waits ``2 ** attempt`` seconds of event time and is queued again by a timer, or by the first outcome at or after
    that moment; after the last attempt the document has failed. Both ends clear the state, and a later outcome begins a new run. An
    outcome that comes while a job waits, or whose status is neither done nor failed, is ignored, as the output says. Outcomes of a document
    inside a micro-batch are taken by (updated_at, job_id); those later than ``delay`` behind the newest are dropped, as are rows without a time.
    """
    timed = outcomes.withColumn("updated_at", F.col("updated_at").cast("timestamp")).where(F.col("updated_at").isNotNull()).withWatermark("updated_at", delay)
    rows = timed.select("document_id", "version_no", "job_id", "status", F.unix_micros("updated_at").alias("at"), "updated_at")
    moved = rows.groupBy("document_id").transformWithState(StageMachine(settings.job_max_attempts), OUTPUT, "Append", "EventTime")
    return moved.withColumns({"moved_at": _moment("moved_at"), "due": _moment("due")})


def _moment(name: str) -> Column:
    return F.timestamp_micros(F.col(name))


def start_machine(outcomes: DataFrame, folder: str, checkpoint: str, delay: str = "0 seconds", settings: Settings = DEFAULTS) -> StreamingQuery:
    """Append the transitions of all outcomes available now to a table; timers need the state store on disk."""
    conf, name = outcomes.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        return start_table(stage_machine(outcomes, delay, settings), folder, checkpoint)
    finally:
        conf.set(name, before) if before else conf.unset(name)
