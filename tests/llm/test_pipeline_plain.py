"""The whole pipeline against stages written plainly."""

import random

import corpus_pipeline
from tests.llm.test_pairs import LOWER, WORDS, components, shingles


def made_up(rng, count):
    return [f"w{rng.randrange(10**6)}" for _ in range(count)]


def fixture():
    rng = random.Random(12)
    item, passage, short = made_up(rng, 30), made_up(rng, 70), made_up(rng, 40)
    docs, labels, number = [], [], 0

    def add(words, toxic=0):
        nonlocal number
        docs.append((number, " ".join(words), "en", "web", len(" ".join(words))))
        labels.append((number, 1, toxic))
        number += 1

    for _ in range(60):
        add(made_up(rng, 80))
    for k in range(30):
        add([*made_up(rng, 40), *rng.choices(["vile", "hateful", "scum"], k=12), *made_up(rng, 10)], 1)
    for k in range(4):
        add([*made_up(rng, 50), *passage, *made_up(rng, 30 + k)])
        add([*made_up(rng, 60), *short, *made_up(rng, 30)])
    base = made_up(rng, 200)
    for k in range(6):  # near copies, linked in a chain
        base = base[:]
        base[20 * k + 3] = f"x{k}"
        add(base)
    for k in range(3):
        add([*made_up(rng, 50), *item, *made_up(rng, 50)])
    for text in ("", "  \n", "One two"):
        docs.append((number, text, "en", "web", len(text)))
        number += 1
    docs.append((number, None, "en", "web", None))
    return docs, labels, [(1, " ".join(item)), (2, None)]


def without_passages(texts, length, words):
    raw = [t.encode() for t in texts]
    count = {}
    for b in raw:
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] = count.get(b[k : k + length], 0) + 1
    out = []
    for b in raw:
        gone = [False] * (len(b) + 1)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept, k = b"", 0
        while k < len(b):
            stop = k
            while gone[stop]:
                stop += 1
            if stop > k and len(b[k:stop].split()) >= words:
                k = stop
            else:
                kept += b[k : max(stop, k + 1)]
                k = max(stop, k + 1)
        out.append(kept.decode())
    return out


def test_pipeline_equals_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels, items = fixture()
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t, *_ in docs if i >= len(labels) or not labels[i][2]]
    root = {i: r for i, _, r in components(left, 5, 80)}
    left = [(i, t) for i, t in left if root[i] == i]
    left = list(zip([i for i, _ in left], without_passages([t or "" for _, t in left], corpus_pipeline.stages.PASSAGE_BYTES, corpus_pipeline.stages.PASSAGE_WORDS)))
    left = [(i, t) for i, t in left if not any(100 * len(shingles(t, 5) & shingles(x, 5)) >= 80 * len(shingles(x, 5)) for _, x in items if x)]
    assert 0 < sum(t != docs[i][1] for i, t in left if t) <= 4 and all(WORDS.findall(t.translate(LOWER)) for i, t in left if i < len(labels))
    tokens = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    expected = {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in left}
    got = {}
    for row in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[row.doc_id] = got.get(row.doc_id, 0) + row.length
    assert got == expected
