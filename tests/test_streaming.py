import datetime as dt

from pyspark.sql import functions as F

from docloom.operators.chunking import chunk_documents, line_blocks
from docloom.settings import Settings
from docloom.streaming.ingest import first_arrivals, read_stream, start_first_arrivals, start_indexing, start_table
from docloom.streaming.jobs import job_transitions


def test_indexing_continues_where_it_stopped(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    source, out, mark = (str(tmp_path / n) for n in ("source", "out", "mark"))
    settings = Settings(embed_dim=16)
    for part in range(2):
        docs.where(F.pmod("document_id", F.lit(2)) == part).coalesce(1).write.mode("append").parquet(source)
        start_indexing(read_stream(spark, source, docs.schema), out, mark, settings=settings).awaitTermination()
    expected = chunk_documents(docs.select("document_id", line_blocks(F.col("text")).alias("blocks")), settings=settings)
    rows = lambda df: sorted(r["chunk_id"] for r in df.select("chunk_id").collect())
    assert rows(spark.read.parquet(out)) == rows(expected)


def test_copies_are_seen_across_batches(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("source", "out", "mark"))
    for texts in (["a", "b"], ["b", "c", "c"]):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(source)
        stream = first_arrivals(read_stream(spark, source, spark.read.parquet(source).schema), F.col("text"))
        start_table(stream, out, mark).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_stored_hashes_in_place_of_state(spark, tmp_path):
    """Restarts, merged hash tables, a batch replayed after its hashes were written, repeated rows, nulls, and no rows of state."""
    source, out, mark = (str(tmp_path / n) for n in ("source", "out", "mark"))
    seen, schema = set(), "doc_id long, text string, prefix string"
    expected = []
    for n in range(7):
        rows = [(10 * n + i, t) for i, t in enumerate([f"t{n}", f"t{n - 1}", f"t{n}", f"t{n - 3}", None if n else "", f"u{n}"])] + [(10 * n, f"t{n}")]
        for i, t in sorted(rows, key=lambda r: r[0]):
            if (t or "") not in seen:
                seen.add(t or "")
                expected.append((i, t))
        spark.createDataFrame([(*r, "x") for r in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = read_stream(spark, source, spark.read.parquet(source).schema)
        if n == 4:  # a replay: the batch's tables are there, its commit is not
            (tmp_path / "mark" / "commits" / "3").unlink()
            (tmp_path / "mark" / "commits" / ".3.crc").unlink(missing_ok=True)
        query = start_first_arrivals(stream, "text", "doc_id", out, mark, open_batches=3)
        query.awaitTermination()
        assert sum(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) == 0
    kept = spark.read.parquet(f"{out}/kept").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(expected)
    assert sorted(p.name for p in (tmp_path / "out" / "closed").iterdir()) == ["2", "5"]


def test_retry_state_survives_restarts(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("source", "out", "mark"))
    start = dt.datetime(2026, 1, 1)
    batches = [[(1, "failed"), (2, "done")], [(3, "failed")], [(4, "failed"), (5, "done")]]
    for batch in batches:
        rows = [(7, "index", i, s, start + dt.timedelta(hours=i)) for i, s in batch]
        spark.createDataFrame(rows, "document_id long, stage string, job_id long, status string, updated_at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = job_transitions(read_stream(spark, source, spark.read.parquet(source).schema))
        start_table(stream, out, mark).awaitTermination()
    made = {r["job_id"]: (r["status"], r["attempt"], r["retry_at"]) for r in spark.read.parquet(out).collect()}
    assert made == {
        1: ("queued", 1, start + dt.timedelta(hours=1, seconds=2)), 2: ("done", 1, None), 3: ("queued", 2, start + dt.timedelta(hours=3, seconds=4)),
        4: ("failed", 3, None), 5: ("done", 3, None),
    }


def test_one_key_of_job_outcomes_costs_little():
    """A stream has very many keys of a few outcomes; a thousand of them took over five seconds."""
    from time import process_time

    import pandas as pd

    from docloom.streaming.jobs import job_transitions

    class Outcomes:
        def groupBy(self, *keys):
            return self

        def applyInPandasWithState(self, step, *rest):
            return step

    class State:
        exists = False

        def update(self, value):
            self.value = value

    times = pd.to_datetime(["2024-01-01 00:00:01", "2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-02 00:00:00"])
    rows = pd.DataFrame({"job_id": [4, 2, 3, 1], "status": ["failed", "done", "failed", "failed"], "updated_at": times})
    step, state, started = job_transitions(Outcomes()), State(), process_time()
    for _ in range(1000):
        made = pd.concat(step((1, "index"), iter([rows[:1], rows[1:]]), state))
    assert process_time() - started < 4
    assert state.value == (3,)
    assert made[["job_id", "attempt", "status"]].values.tolist() == [[2, 0, "done"], [3, 1, "queued"], [4, 2, "queued"], [1, 3, "failed"]]
    assert [str(t)[11:19] for t in made["retry_at"]] == ["", "00:00:03", "00:00:05", ""]
