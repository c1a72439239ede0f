"""Generations of a table: untouched parts stay, old readers go on, writers conflict."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.sources.versioned import Conflict, Versioned

SCHEMA = "document_id bigint, chunk_id string, text string"


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    table = Versioned(spark, str(tmp_path / "table"))
    state = {(i % 40, f"c{i}"): f"t{i}" for i in range(120)}
    frame = lambda rows: spark.createDataFrame([(*k, v) for k, v in rows.items()], SCHEMA)
    table.create(frame(state), ["document_id", "chunk_id"], parts=16)
    seen = {0: dict(state)}
    for turn in range(1, 4):
        changed = {k: f"{v}/{turn}" for k, v in rng.sample(sorted(state.items()), 3)} | {(900 + turn, "new"): "n"}
        gone = rng.sample(sorted(set(state) - set(changed)), 2)
        before = table.generation()
        made = table.change(frame(changed), spark.createDataFrame([*gone, (12345, "none")], "document_id bigint, chunk_id string"))
        state = {k: v for k, v in {**state, **changed}.items() if k not in gone}
        seen[turn] = dict(state)
        assert made.counts == {"written": 4, "deleted": 2, "failed": 0}
        same = [p for p in before.folders if made.folders.get(p) == before.folders[p]]
        assert len(same) >= 16 - 7
    for turn, expected in seen.items():
        assert {(r.document_id, r.chunk_id): r.text for r in table.read(turn).collect()} == expected
    assert table.generations() == [0, 1, 2, 3]


def test_failures_and_conflicts(spark, tmp_path):
    table = Versioned(spark, str(tmp_path / "table"))
    table.create(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], SCHEMA), ["document_id", "chunk_id"], parts=4)
    opened = table.read()
    rows = spark.createDataFrame([(1, "a", "new", None), (2, "b", "broken", "no text layer")], SCHEMA + ", error string")
    made = table.change(rows, error="error")
    assert made.counts == {"written": 1, "deleted": 0, "failed": 1}
    assert sorted(r.text for r in table.read().collect()) == ["new", "y"] and sorted(r.text for r in opened.collect()) == ["x", "y"]
    with pytest.raises(Conflict):
        table._commit(made)
    table.change(gone=table.read().select("document_id", "chunk_id"))
    assert table.read().collect() == [] and table.change(spark.createDataFrame([(5, "e", None)], SCHEMA)).number == 3
    assert table.read().select(F.col("text")).collect()[0].text is None
