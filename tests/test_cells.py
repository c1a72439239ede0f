"""Cells around pivots against scoring every pair."""

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import cells


def clustered(seed, count, dim=8, groups=6, spread=0.08):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(99).normal(size=(groups, dim))
    return [(middles[i % groups] + spread * rng.normal(size=dim)).tolist() for i in range(count)]


def cosines(left, right):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    return np.array([[round(float(unit(a) @ unit(b)), 9) for b in right] for a in left])


def test_nearest_equals_brute_force_and_reads_few_cells(spark, tmp_path):
    points, asked = clustered(1, 600), clustered(2, 9)
    rows = [(i, v, i % 3) for i, v in enumerate(points)] + [(9000, None, 0), (9001, [0.0] * 8, 0), (9002, points[5], 2)]
    place = str(tmp_path / "cells")
    cells.build(spark.createDataFrame(rows, "id bigint, vector array<double>, kind int"), place, pivots=24)
    queries = spark.createDataFrame([*enumerate(asked), (77, None)], "query_id int, vector array<double>")
    known = [(i, v, k) for i, v, k in rows if v and any(v)]
    for visible, kinds, k in ((None, {0, 1, 2}, 7), (F.col("kind") == 2, {2}, 300)):
        found, read = cells.nearest(spark, place, queries, k, visible)
        some = [(i, v) for i, v, kind in known if kind in kinds]
        close = cosines(asked, [v for _, v in some])
        expected = set()
        for q in range(len(asked)):
            best = sorted((-s, i) for s, (i, _) in zip(close[q], some))[:k]
            expected |= {(q, i, rank) for rank, (_, i) in enumerate(best, 1)}
        assert {(r.query_id, r.id, r["rank"]) for r in found.collect()} == expected
        if k == 7:
            used = read.collect()
            assert len(used) == len(asked) and sum(r.read for r in used) < 0.5 * sum(r.cells for r in used)


def test_similar_pairs_equal_all_pairs(spark):
    left, right = clustered(3, 150), clustered(4, 60)
    one = [(i, f"d{i % 3}" if i % 10 else None, v) for i, v in enumerate(left)] + [(900, "d1", None), (901, "d1", [0.0] * 8), (902, "d1", [1.0, 2.0]), (903, "d1", [1.0] * 9)]
    two = [(i, f"d{i % 4}" if i % 5 else None, v) for i, v in enumerate(right)] + [(800, None, [1.0, 2.0]), (801, None, None)]
    schema = "id bigint, scope string, vector array<double>"
    for threshold, pivots in ((0.9, 12), (0.2, 5), (0.97, 256)):
        close, compared = cells.similar_pairs(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), threshold, pivots)
        expected = set()
        for i, a, v in one:
            for j, b, w in two:
                if v and w and any(v) and len(v) == len(w) and (b is None or a == b) and round(float(cosines([v], [w])[0, 0]), 6) >= threshold:
                    expected.add((i, j))
        assert {(r.left_id, r.right_id) for r in close.collect()} == expected and len(expected) > 5
        if threshold > 0.8:
            assert compared.count() < 0.3 * len(one) * len(two)
    assert cells.similar_pairs(spark.createDataFrame(one, schema), spark.createDataFrame([], schema), 0.5)[0].collect() == []
