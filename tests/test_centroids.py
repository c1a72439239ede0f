"""Centroids kept by steps against centroids of all confirmed links."""

import random

import numpy as np

from docloom.operators import centroids, enrich

LINKS = "document_id bigint, tag_id bigint, source string, status string"


def test_random_changes_equal_recomputation(spark):
    rng = random.Random(7)
    vectors = {d: [round(rng.gauss(0, 1), 3) for _ in range(4)] for d in range(30)} | {30: None, 31: [1.0, 2.0]}
    frame = spark.createDataFrame(list(vectors.items()), "document_id bigint, vector array<double>")
    links = spark.createDataFrame([(d, d % 4, "ai", "suggested" if d % 3 else "confirmed") for d in range(32)], LINKS)
    confirmed = links.where("status = 'confirmed'").selectExpr("tag_id", "document_id", "1 AS step")
    state = centroids.advanced(None, confirmed, frame)
    expected = {(r.document_id, r.tag_id): r.status for r in links.collect()}
    for turn in range(3):
        asked = [(rng.randrange(32), rng.randrange(5), rng.choice(["confirm", "remove"]), k) for k in range(25)]
        if turn == 2:
            asked += [(d, 1, "remove", 99) for d in range(32)]
        links, steps = centroids.apply_changes(links, spark.createDataFrame(asked, "document_id bigint, tag_id bigint, action string, at int"))
        for d, t, action, _ in asked:
            if action == "confirm":
                expected[d, t] = "confirmed"
            else:
                expected.pop((d, t), None)
        state = spark.createDataFrame(centroids.advanced(state, steps, frame).collect(), "tag_id bigint, sums array<double>, n bigint")
        links = spark.createDataFrame(links.collect(), LINKS)
        assert {(r.document_id, r.tag_id): r.status for r in links.collect()} == expected
        plain = {r.tag_id: r.centroid for r in enrich.tag_centroids(links.where("status = 'confirmed' AND document_id < 30"), frame).collect()}
        got = {r.tag_id: r.centroid for r in centroids.centroids(state).collect()}
        assert got.keys() == plain.keys() and all(np.allclose(got[t], plain[t], atol=1e-9) for t in got)
    assert 1 not in got
