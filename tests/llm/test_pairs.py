"""Near-duplicate groups, repeats and containment against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from docloom.llm import containment, repeats, superminhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, node string, key bigint, n bigint"


def frame(spark, rows, schema=SCHEMA):
    width = len(schema.split(", "))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def shingles(text, k):
    words = WORDS.findall((text or "").translate(LOWER))
    if 0 < len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(rows, k, threshold):
    sets = [(i, shingles(t, k)) for i, t in rows]
    group = list(range(len(rows)))

    def top(n):
        while group[n] != n:
            n = group[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                group[top(a)] = top(b)
    smallest = {}
    for a in range(len(rows)):
        smallest[top(a)] = min(smallest.get(top(a), rows[a][0]), rows[a][0])
    return {(rows[a][0], len(sets[a][1]), smallest[top(a)] if sets[a][1] else rows[a][0]) for a in range(len(rows))}


def family(seed, members, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for _ in range(members):
        words = base[:]
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


EDGES = ["", None, " \n\t", "One", "one", "one two", "ONE  two", "one two three", "É é", "a b c d", "Same text here now", "same TEXT here now"]


@pytest.mark.parametrize("edits", [1, 2])
def test_groups_equal_brute_force(spark, edits):
    texts = EDGES + family(edits, 12, edits) + family(9 + edits, 5, 1) + family(20, 1, 0) * 4
    rows = list(enumerate(texts))
    got = superminhash.near_duplicates(frame(spark, rows), 3, 85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == components(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_links_that_no_hub_shows_are_found_in_cells(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "BLOCK", 2)
    rows = list(enumerate(family(5, 30, 5)))  # similar enough to share buckets, most pairs below the threshold
    got = superminhash.near_duplicates(frame(spark, rows), 3, 85, bands=60, rows=1).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == components(rows, 3, 85)


def test_cell_links_join_all_groups_once():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 5], [9, 10])]
    found = superminhash.cell_links(sets, [b"a", b"b", b"c", b"d"], 60)
    assert len(found) == 2 and {x for pair in found for x in pair} == {b"a", b"b", b"c"}


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)]
    got = superminhash.near_duplicates(frame(spark, rows), 3, 85).collect()
    assert sorted([(str(r.doc_id), r.component_id, r.kept) for r in got], key=str) == sorted([("None", 3, False), ("3", 3, True), ("3", 3, True), ("None", None, True)], key=str)
    assert superminhash.near_duplicates(frame(spark, []), 3, 85).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common, one, two = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (800, 100, 100))
    sets = [np.unique(np.concatenate([common, x])) for x in (one, two)]
    doc = np.repeat([0, 1], [len(s) for s in sets])
    made = superminhash.signatures(doc, np.concatenate(sets), 2, 256)
    assert abs((made[0] == made[1]).mean() - 0.8) < 0.08
    small = superminhash.signatures(np.zeros(2, np.int64), np.array([5, 6], np.uint64), 1, 256)
    assert (small < np.uint64(256 << 32)).all() and len(set((small[0] >> np.uint64(32)).tolist())) > 50


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(0)
    for _ in range(200):
        text = rng.integers(0, rng.integers(1, 5), rng.integers(0, 70)).astype(np.uint8)
        assert repeats.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def stripped(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, b in raw:
        for k in range(len(b) - length + 1):
            count[b[k : k + length]] = count.get(b[k : k + length], 0) + 1
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_runs", [8192, 1])
def test_repeats_equal_brute_force(spark, bucket_runs):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdé ") for _ in range(200))
    texts = ["", None, "short", "a" * 300, "ab" * 100, passage, passage]
    texts += ["".join(rng.choice("xyzw ") for _ in range(rng.randrange(300))) + passage[rng.randrange(60) : 200 - rng.randrange(60)] + "".join(rng.choice("klm") for _ in range(90)) for _ in range(25)]
    rows = [*enumerate(texts), (None, "nobody"), (6, texts[8])]
    got = repeats.remove_repeats(frame(spark, rows), 70, bucket_runs=bucket_runs).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == stripped(rows, 70)


def test_cut_texts_keep_columns_and_characters(spark):
    passage = "éü" * 60
    docs = frame(spark, [(1, "x" + passage + "q"), (2, "yy" + passage), (3, None), (4, "")], "doc_id bigint, text string, spans string, text_key bigint, n_chars bigint".replace("text_key bigint, ", "").replace("spans string, ", ""))
    got = {r.doc_id: r for r in repeats.cut_repeats(docs, 70).collect()}
    assert (got[1].text, got[1].n_chars, got[2].text, got[3].text, got[4].text) == ("xq", 2, "yy", None, "")
    assert repeats.cut_repeats(docs.limit(0), 70).collect() == []


def test_containment_equals_sql(spark, small):
    database = duckdb.connect()
    for name in ("documents", "benchmark"):
        database.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    rows = containment.op5(spark, small).select("doc_id", "item_id", "n_item", "n_shared").collect()
    assert sorted(map(tuple, rows)) == sorted(database.sql(f"SELECT doc_id, item_id, n_item, n_shared FROM ({containment.ORACLE})").fetchall())


def test_containment_of_short_items_and_large_sets(spark):
    rng = random.Random(7)
    items = [(i, " ".join(f"t{i}x{k}" for k in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 12, 40, 41])] + [(20, ""), (21, None), (22, "t7x0")]
    long = " ".join(t for _, t in items if t) + " " + " ".join(f"z{rng.randrange(9999)}" for _ in range(3000))
    docs = [(1, long), (2, items[6][1].upper()), (3, " ".join(items[6][1].split()[:34])), (4, " ".join(items[6][1].split()[:20])), (5, None), (6, ""), (7, items[1][1])]
    benchmark = frame(spark, items, "item_id bigint, text string, items string, key string")
    got = {(r.doc_id, r.item_id) for r in containment.contaminated(frame(spark, docs), benchmark).collect()}
    expected = set()
    for d, text in docs:
        words = WORDS.findall((text or "").translate(LOWER))
        for i, item in items:
            own = WORDS.findall((item or "").translate(LOWER))
            k = min(5, len(own))
            if own:
                sets = [{tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for w in (words, own)]
                if 100 * len(sets[0] & sets[1]) >= 80 * len(sets[1]):
                    expected.add((d, i))
    assert got == expected and (1, 0) in got
    empty = frame(spark, [])
    assert containment.contaminated(empty, benchmark).collect() == [] and containment.contaminated(frame(spark, docs), benchmark.limit(0)).collect() == []


def test_bandings_are_safe():
    for q in (1, 5, 40, 300):
        for c in range(1, 14):
            rows = containment.rows_for(q, (1 << c) - 1, 80)
            if rows:
                s = min(1, 0.8 / (((1 << c) - 1) / q + 0.2))
                assert (1 - s**rows) ** (containment.LENGTH // rows) <= 1e-6
