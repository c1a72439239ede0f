import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.text import normalize
from docloom.operators import dedup
from docloom.settings import DEFAULTS


def brute_force(spark, texts, vectors, settings):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    signed = dedup.with_signatures(df).select("id", "signature", dedup.bands(F.col("signature")).alias("b")).collect()
    sig = {r["id"]: np.array(r["signature"]) for r in signed if r["signature"] is not None}
    bands = {r["id"]: {(b["band"], b["bucket"]) for b in r["b"]} for r in signed if r["signature"] is not None}
    found = {}
    for i in sig:
        scored = sorted((-(sig[i] == sig[j]).mean(), j) for j in sig if j != i and bands[i] & bands[j])
        if scored and -scored[0][0] >= settings.near_dup_jaccard:
            found[i] = (scored[0][1], "near", round(-scored[0][0], 6))
        else:
            close = [(s, j) for s, j in scored if vectors is not None and round(float(vectors[i] @ vectors[j]), 9) >= settings.semantic_dup_threshold]
            if close:
                found[i] = (close[0][1], "semantic", round(-close[0][0], 6))
    return found


def corpus():
    random.seed(9)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(random.choices(words, k=120)) for _ in range(12)]
    texts = []
    for text in base:
        texts.append(text)
        for edits in (1, 3, 8, 25):
            tokens = text.split()
            for _ in range(edits):
                tokens[random.randrange(len(tokens))] = random.choice(words)
            texts.append(" ".join(tokens))
    # One group of copies holds a third of all rows, in different spacing and case.
    texts += [base[0].upper() if i % 2 else "  " + base[0].replace(" ", "  ") for i in range(len(texts) // 2)]
    texts += ["", "  ", "short text", "Short  TEXT"]
    random.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [512, 3])
@pytest.mark.parametrize("with_vectors", [False, True])
def test_tiers_equal_brute_force(spark, block, with_vectors):
    texts = corpus()
    settings = replace(DEFAULTS, dedup_block_rows=block)
    vectors = None
    columns = "id long, text string"
    rows = list(enumerate(texts))
    if with_vectors:
        from docloom.functions.vectors import embed_texts

        settings = replace(settings, semantic_dup_threshold=0.8)
        vectors = embed_texts(texts, 64)
        rows = [(i, t, v.tolist()) for (i, t), v in zip(rows, vectors)]
        columns += ", vector array<double>"
    made = dedup.duplicate_tiers(spark.createDataFrame(rows, columns), "id", vector="vector" if with_vectors else None, settings=settings)
    result = {r["id"]: (r["duplicate_of"], r["duplicate_tier"], round(r["similarity"], 6)) for r in made.collect()}
    assert result == brute_force(spark, texts, vectors, settings)
    assert {tier for _, tier, _ in result.values()} == ({"near", "semantic"} if with_vectors else {"near"})


def test_string_keys_tie_to_the_smallest(spark):
    texts = [("b", "x y z"), ("a", "x y z"), ("c", "X  y z")]
    made = dedup.duplicate_tiers(spark.createDataFrame(texts, "id string, text string"), "id")
    assert {r["id"]: r["duplicate_of"] for r in made.collect()} == {"a": "b", "b": "a", "c": "a"}


def test_exact_duplicates(spark):
    texts = [(5, "same"), (2, "same"), (9, "same"), (1, "Same"), (3, "other")]
    made = dedup.exact_duplicates(spark.createDataFrame(texts, "document_id long, text string"))
    assert {tuple(r) for r in made.collect()} == {(5, 2), (9, 2)}


def test_similarity(spark):
    value = lambda a, b: spark.range(1).select(dedup.signature_similarity(F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert value([1, 2, 3, 4], [1, 2, 0, 4]) == 0.75 and value([1], [1, 2]) == 0.0


def _plain_signature(text):
    import hashlib

    words = text.split()
    grams = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    hashes = [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % dedup.PRIME for g in grams]
    return [min((a * h + b) % dedup.PRIME for h in hashes) for a, b in map(dedup.permutation, range(128))] if words else None


def test_signatures_equal_the_plain_rule_for_any_blanks_and_lengths(spark):
    texts = ["", " 　\x1c ", "One", "a b\tc  d", "a\x85b\xa0c d e F", "É ß ΑΣ ΑΣ İ 会议 x\x1fy", " ".join(str(i % 700) for i in range(1500))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").select("doc_id", "text", normalize(F.col("text")).alias("n"))
    for r in dedup.with_signatures(rows).collect():
        assert r["signature"] == _plain_signature(r["n"]), r["doc_id"]


def test_texts_are_normalised_outside_the_plan(spark):
    """The one pass over the texts lower-cases them and nothing more; blanks are parted where the shingles are made."""
    rows = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    plan = dedup.with_signatures(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "lower" in plan and "regexp_replace" not in plan


def test_buckets_are_hashed_once(spark):
    units = spark.createDataFrame([(i, [7] * 128) for i in range(6)], "unit long, signature array<long>")
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<long>")
    def counting(signature):
        read.add(1)
        return signature

    placed = dedup._cell_members(units.withColumn("signature", counting("signature")), DEFAULTS)
    assert {r["unit"] for r in placed.collect()} == set(range(6)) and read.value == 6
