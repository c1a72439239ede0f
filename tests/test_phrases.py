"""Phrase correction against all paths, and against the choice word by word."""

import itertools
import math
import random

from pyspark.sql import functions as F

from docloom.operators import phrases, suggest


def titles_of(spark, names):
    rows = [(i, t, f"d{i % 2}") for i, t in enumerate(names)]
    frame = spark.createDataFrame(rows, "document_id bigint, title string, department_id string")
    return suggest.title_index(frame.withColumn("allowed_groups", F.array("department_id")))


def test_context_decides(spark):
    titles = titles_of(spark, ["leave policy"] * 2 + ["lava rock"] * 6 + ["staff leave policy"] * 2)
    queries = spark.createDataFrame([(1, "lave policy"), (2, "leave policy"), (3, "zzzz"), (4, ""), (5, "lave rocks")], "query_id int, query string")
    got = {r.query_id: r.suggestion for r in phrases.correct(titles, queries, ["d0", "d1"]).collect()}
    assert got == {1: "leave policy", 5: "lava rock"}
    word_by_word = {r.query_id: r.suggestion for r in suggest.did_you_mean(titles, queries, ["d0", "d1"]).collect()}
    assert word_by_word[1] == "lava policy"
    assert phrases.correct(titles, queries, ["nobody"]).collect() == []


def test_best_path_equals_all_paths():
    rng = random.Random(3)
    for _ in range(300):
        length, words = rng.randrange(1, 5), "abc"
        options = [sorted(rng.sample(words, rng.randrange(1, 4))) for _ in range(length)]
        score = {}
        runs = []
        for pos in range(length):
            for run in itertools.product(*options[max(0, pos - 2) : pos + 1]):
                padded = (None,) * (3 - len(run)) + run
                score[pos, padded] = -rng.choice([1.0, 2.0, math.log(3)])
                runs.append((pos, *padded, score[pos, padded]))
        rng.shuffle(runs)
        every = []
        for path in itertools.product(*options):
            total = 0.0
            for pos in range(length):
                run = path[max(0, pos - 2) : pos + 1]
                total += score[pos, (None,) * (3 - len(run)) + run]
            every.append((-round(total, 7), path))
        best = min(every)[0]
        assert phrases.best_path(runs).split() in [list(p) for c, p in every if c == best]


def test_paths_that_tie_go_by_alphabet_whatever_their_steps():
    # Two title runs seen once each: counts of shorter runs cancel out, so both paths have probability 1 / 1000.
    def steps(name, first, second):
        scores = (math.log(first / 1000), math.log(second / first), math.log(1 / second))
        words = [f"{name}{i}" for i in range(3)]
        return [(pos, *([None, None] + words)[pos : pos + 2], words[pos], score) for pos, score in enumerate(scores)]

    for first, second in ((7, 3), (9, 4), (20, 3)):
        assert phrases.best_path(steps("a", first, second) + steps("b", 11, 5)) == "a0 a1 a2"
