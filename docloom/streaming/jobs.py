"""The job state machine over a stream of job outcomes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from docloom.settings import DEFAULTS, Settings

OUTPUT = "document_id bigint, stage string, job_id bigint, attempt int, status string, retry_at timestamp"
STATE = "failures int"


def job_transitions(outcomes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(document_id, stage, job_id, status, updated_at)`` outcomes to queue transitions.

    Each (document, stage) keeps only its number of failures. A failure is queued again
    ``2 ** attempt`` seconds after it happened while attempts remain, then failed for good; a success is
    done. Outcomes of one key inside a micro-batch are taken in time order.
    """
    most = settings.job_max_attempts

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Most keys have a few outcomes in a batch, so plain arrays count: every pandas operation would cost more than the work itself.
        failures = state.get[0] if state.exists else 0
        parts = list(batches)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        jobs, times = rows["job_id"].to_numpy(), rows["updated_at"].to_numpy()
        order = np.lexsort((jobs, times))
        status, times = rows["status"].to_numpy(dtype=object)[order], times[order]
        failed = np.array([value == "failed" for value in status], dtype=bool)
        attempts = failures + np.cumsum(failed)
        retried = failed & (attempts < most)
        delay = (2 ** np.minimum(attempts, most)).astype("timedelta64[s]")
        state.update((int(attempts[-1]),))
        yield pd.DataFrame(
            {
                "document_id": key[0], "stage": key[1], "job_id": jobs[order], "attempt": attempts.astype("int32"),
                "status": np.where(retried, "queued", status), "retry_at": np.where(retried, times + delay, np.datetime64("NaT")),
            }
        )

    return outcomes.groupBy("document_id", "stage").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")
