"""Folder trees of any depth, and cycles."""

from docloom.operators import folders

SCHEMA = "folder_id string, name string, parent_id string"


def test_deep_chains_and_cycles(spark):
    rows = [(f"f{i:04d}", f"n{i}", f"f{i - 1:04d}" if i else None) for i in range(1000)]
    rows += [("a", "A", "c"), ("b", "B", "a"), ("c", "C", "b"), ("d", "D", "c"), ("self", "S", "self"), ("lost", "L", "nowhere"), ("low", "W", "lost"), ("side", "E", "f0500")]
    tree = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.folder_id: r for r in folders.paths(tree).collect()}
    assert len(got) == len(rows)
    assert got["f0999"].path == [f"n{i}" for i in range(1000)] and got["f0000"].path == ["n0"]
    assert got["lost"].path == ["L"] and got["low"].path == ["L", "W"] and got["side"].path == [f"n{i}" for i in range(501)] + ["E"]
    assert {k for k, r in got.items() if r.cyclic} == {"a", "b", "c", "d", "self"} and all(got[k].path is None for k in "abcd")
    below = {r.folder_id: r.depth for r in folders.descendants(tree, "f0400").collect()}
    assert below == {**{f"f{i:04d}": i - 400 for i in range(401, 1000)}, "side": 101}
    assert {r.folder_id: r.depth for r in folders.descendants(tree, "a").collect()} == {"b": 1, "c": 2, "d": 3}
    assert {r.folder_id: r.depth for r in folders.descendants(tree, "nowhere").collect()} == {"lost": 1, "low": 2}
    assert folders.descendants(tree, "unknown").collect() == [] and folders.paths(tree.limit(0)).collect() == []
