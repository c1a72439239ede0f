import datetime as dt

from docloom.streaming.ingest import read_stream
from docloom.streaming.machine import start_machine

START = dt.datetime(2026, 1, 1)
SCHEMA = "document_id long, version_no int, job_id long, status string, updated_at timestamp, stage string"


def run(spark, tmp_path, batches):
    source, out, mark = (str(tmp_path / n) for n in ("source", "out", "mark"))
    for batch in batches:
        rows = [(d, v, j, s, None if at is None else START + dt.timedelta(seconds=at), "x") for d, v, j, s, at in batch]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = start_machine(read_stream(spark, source, spark.read.parquet(source).schema), out, mark)
        query.awaitTermination()
    rows = spark.read.parquet(out).collect()
    seconds = lambda x: None if x is None else (x - START).total_seconds()
    return sorted(((r.document_id, seconds(r.moved_at), r.job_id or 0, r.stage, r.attempt, r.status, seconds(r.due), r.document_status) for r in rows), key=lambda r: (r[0] or 0, *r[1:5])), query


def test_a_job_fails_twice_and_then_finishes(spark, tmp_path):
    """Each restart goes on from the state; timers ring when other documents move the time on."""
    batches = [
        [(7, 1, 1, "failed", 10.5)], [(8, 2, 2, "done", 100)], [(7, 1, 3, "failed", 110), (7, 1, 4, "done", 112), (None, 1, 5, "odd", 111), (9, 1, 6, "done", None)], [(8, 2, 7, "done", 200)],
        [(7, 1, 8, "done", 210), (7, 1, 9, "done", 211), (7, None, 10, "failed", 212), (7, 1, 11, "failed", 220), (7, 1, 12, "failed", 230)], [(6, 1, 13, "failed", 300)],
    ]
    got, query = run(spark, tmp_path, batches)
    assert [r for r in got if r[0] == 7] == [
        (7, 10.5, 1, "extract", 1, "waiting", 12.5, None), (7, 12.5, 1, "extract", 1, "queued", None, None),
        (7, 110, 3, "extract", 2, "waiting", 114, None), (7, 112, 4, "extract", 2, "ignored", None, None), (7, 114, 3, "extract", 2, "queued", None, None),
        (7, 210, 8, "extract", 2, "done", None, "EXTRACTED"), (7, 210, 8, "index", 0, "queued", None, None),
        (7, 211, 9, "enrich", 0, "queued", None, None), (7, 211, 9, "index", 0, "done", None, "INDEXED"),
        (7, 212, 10, "enrich", 1, "waiting", 214, None), (7, 214, 10, "enrich", 1, "queued", None, None),
        (7, 220, 11, "enrich", 2, "waiting", 224, None), (7, 224, 11, "enrich", 2, "queued", None, None), (7, 230, 12, "enrich", 3, "failed", None, "FAILED"),
    ]
    assert [r for r in got if r[0] == 8] == [
        (8, 100, 2, "delta", 0, "queued", None, None), (8, 100, 2, "extract", 0, "done", None, "EXTRACTED"), (8, 200, 7, "delta", 0, "done", None, "READY"),
    ]
    assert [r for r in got if r[0] == 6] == [(6, 300, 13, "extract", 1, "waiting", 302, None)]
    assert [r[5] for r in got if r[0] is None] == ["ignored"] and not [r for r in got if r[0] == 9]
