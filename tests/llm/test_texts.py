"""Scoring, packing, labelling and grading of texts."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docloom.llm import backoff, crf, ordinal, packing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, slice string, part int, n bigint"


def frame(spark, rows, schema=DOCS):
    width = len(schema.split(", "))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def corpus(seed, count):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["The", "of", "é", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(60)))) for i in range(count)]


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_brute_force(spark, order):
    rows = [*corpus(1, 60), (None, "the of"), (61, None), (62, ""), (3, "repeated id"), (63, "The The the")]
    got = backoff.backoff_scores(frame(spark, rows), order, prior=2.0, parts=3).collect()
    tokens = [(i, [*WORDS.findall((t or "").translate(LOWER)), "</end>"]) for i, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in tokens]
    counts = [Counter() for _ in range(order + 1)]
    grams = lambda t: [[tuple((["<s>"] * order + t)[order + k - n : order + k + 1]) for n in range(order)] for k in range(len(t))]
    for (_, t), out in zip(tokens, held):
        if not out:
            for own in grams(t):
                counts[0].update([own[0]])
                for n in range(1, order):
                    counts[n].update([own[n]])
    total, types = sum(counts[0].values()), len(counts[0])
    training = held.count(False)

    def history(gram):
        return training if set(gram) == {"<s>"} else counts[len(gram) - 1][gram]

    expected = []
    for (i, t), out in zip(tokens, held):
        base = score = 0.0
        for own in grams(t):
            p = (counts[0][own[0]] + 1) / (total + types + 1)
            base += math.log10(p)
            for n in range(1, order):
                p = (counts[n][own[n]] + 2.0 * p) / (history(own[n][:-1]) + 2.0)
            score += math.log10(p)
        expected.append((i, out, len(t), sum(counts[0][g[0]] > 0 for g in grams(t)), total, round(base, 8), round(score, 8)))
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), round(r.score, 8)) for r in got], key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_traversal_equals_closed_form_and_arcs_leave_the_carried_state(order):
    texts = [(t or "").encode() for _, t in [*corpus(5, 80), (0, ""), (1, "The"), (2, "new words only here"), (3, "the of " * 5000)]]
    own = backoff.Slice(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), order)
    training = np.arange(len(texts)) % 3 > 0
    for training in (training, np.zeros(len(texts), bool)):
        counts = own.counts(training)
        facts = int(counts[0].sum()), int((counts[0] > 0).sum()), int(training.sum()), 3.0
        automaton = backoff.Automaton(own, counts, *facts)
        for got, expected in zip(automaton.scores(own), backoff.walk(own, counts, *facts)):
            assert np.allclose(got, expected, rtol=1e-12)
        # Step by step: a state's arc at a position leaves that state, a failure arc leads one token down.
        for begin, end in zip(own.firsts, own.ends):
            state = automaton.start
            for at in range(begin, end + 1):
                arc = automaton.arcs[automaton.depth[state]][at]
                while automaton.target[arc] < 0:
                    assert automaton.source[arc] == state or automaton.fail_weight[state] == 0
                    assert automaton.depth[automaton.fail_to[state]] == automaton.depth[state] - 1
                    state = automaton.fail_to[state]
                    arc = automaton.arcs[automaton.depth[state]][at]
                assert automaton.source[arc] == state
                state = automaton.target[arc]


def test_ngrams_go_to_the_part_of_their_leading_bits():
    keys = np.sort(np.random.default_rng(2).integers(0, 1 << 64, 500, dtype=np.uint64, endpoint=False))
    for parts in (1, 3, 100_000):
        own, cuts = backoff._cuts(keys, parts)
        assert np.repeat(own, np.diff(cuts)).tolist() == [(int(k) >> 32) * parts >> 32 for k in keys]
    assert [len(x) for x in backoff._cuts(keys[:0], 7)] == [0, 1]


def test_scoring_nothing(spark):
    assert backoff.backoff_scores(frame(spark, [])).collect() == []


def test_pieces_hold_each_token_once(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    rows = [(i, " ".join(f"Word{rng.randrange(900)}é" for _ in range(rng.choice([3, 40, 300, 900])))) for i in range(60)] + [(90, None), (91, ""), (None, "nobody"), (3, "again")]
    pieces = packing.pack(frame(spark, rows), window=256).collect()
    ids = sorted([(i, (*plain.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in rows], key=str)
    cover = Counter()
    for p in pieces:
        assert 0 < p.length <= 256
        fits = [own for i, own in ids if i == p.doc_id and len(own) == p.doc_tokens and zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32]
        assert fits
        cover[p.doc_id, p.doc_tokens] += p.length
    assert cover == Counter({k: v for k, v in Counter({(i, len(own)): len(own) for i, own in ids}).items()})
    padding = 0
    for _, group in itertools.groupby(sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        at = 0
        for p in group:
            assert p.offset == at
            at += p.length
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding == 0 and packing.pack(frame(spark, [])).collect() == []


@pytest.mark.parametrize("tasks", [1, 7])
def test_windows_do_not_depend_on_the_spread_of_rows(spark, tasks):
    rng = random.Random(5)
    rows = [(i, " a" * rng.choice([43, 83, 100, 26, 155, rng.randrange(1, 900)])) for i in range(400)] + [(400 + i, " a" * 63) for i in range(200)]
    pieces = packing.pack(frame(spark, rows).repartition(tasks), window=128).collect()
    histogram = Counter((len(t) // 2 + 1) % 128 for _, t in rows)
    del histogram[0]
    plan = packing.plan_of(histogram, 128)
    planned = [p for p in pieces if p.sequence_id < plan.windows]
    assert plan.windows > 100 and len(planned) == sum(last - first for _, first, last, *_ in plan.segments) and all(p.start + p.length == p.doc_tokens for p in planned)
    full = [p for p in pieces if p.sequence_id >= 1 << packing.TASK_BITS]
    over = [p for p in pieces if plan.windows <= p.sequence_id < 1 << packing.TASK_BITS]
    # Each window of the stream cuts at most one remainder more.
    assert sum(p.length for p in over) == plan.size and len(over) <= sum(histogram[a] - first for a, first, _ in plan.stream) + plan.size // 128 + 8
    assert len(full) == sum((len(t) // 2 + 1) // 128 for _, t in rows) and sum(p.length for p in pieces) == sum(len(t) // 2 + 1 for _, t in rows)
    borders = {*range(128, plan.size, 128), *(at for at, _ in plan.sequences(128))}
    ends = list(itertools.accumulate([a for a, first, _ in plan.stream for _ in range(histogram[a] - first)], initial=0))
    assert len(over) == sum(1 + sum(low < b < high for b in borders) for low, high in zip(ends, ends[1:]))


def test_one_very_long_text_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "word " * 60000, 5, "x", 7), (1, "word " * 60000, 5, "x", 7)], "doc_id bigint, text string, length int, row string, task int")
    pieces = packing.pack(rows).collect()
    total = pieces[0].doc_tokens
    assert total > 60000 and sum(p.length for p in pieces) == 2 * total and Counter(p.start for p in pieces)[0] == 2


ADDED = "<|endoftext|>"


def test_added_tokens_get_the_ids_of_the_json_form(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [ADDED, f"a {ADDED} b", f"a{ADDED}b", f"{ADDED}{ADDED}", f"x  {ADDED}  \n {ADDED}\té", f"{ADDED[:-1]} {ADDED.upper()} <{ADDED}>|>", f"<|endof{ADDED}text|>", "it's  " + ADDED * 3 + "'s " + "é" * 9]
    expected = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert expected[1] == [64, 220, 50256, 275, 1]
    for p in packing.pack(frame(spark, enumerate(texts)), window=4096).collect():
        own = expected.pop(p.doc_id) if p.start == 0 and p.length == p.doc_tokens else expected[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())


def test_least_squares_meets_the_histogram():
    histogram = {1000: 50, 1048: 50, 500: 30, 774: 60}
    combos = packing.combinations(histogram)
    counts = packing.repeat_counts(histogram, combos)
    made = Counter()
    for combo, count in zip(combos, counts):
        assert sum(combo) == packing.WINDOW and count >= 0
        for a in combo:
            made[a] += count
    assert (1048, 1000) in combos and (774, 774, 500) in combos and all(abs(made[a] - histogram[a]) < 1 for a in histogram)


@pytest.mark.parametrize("text", ["", "a b", "one two three\n\none two three\n  \nx", "a b c d e a b c d e f\n#*$ %&|<>", "é é\r\né é\n" * 3, "\n\nlast line without end", "a a a a a a a"])
def test_counts_equal_brute_force(spark, text):
    words, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    raw = np.frombuffer(("xx yy" + text + "zz").encode(), np.uint8)
    own = crf.Lines(raw, np.array([0, 5, 5 + len(text.encode()), len(raw)]))
    got = [int(v[1]) for v in (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words)]
    assert got == [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]
    assert int((own.doc == 1).sum()) == len(lines)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(4)
    sizes, moves = [3, 0, 1, 5, 2], rng.normal(size=(2, 2))
    doc = np.repeat(np.arange(5), sizes)
    scores = rng.normal(size=(len(doc), 2))
    labels = crf.viterbi(doc, scores, moves, 5)
    for d in range(5):
        own = scores[doc == d]
        value = lambda path, own=own: sum(own[t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
        if len(own):
            assert math.isclose(value(labels[doc == d].tolist()), max(value(p) for p in itertools.product(range(2), repeat=len(own))))


def test_line_labels_hold_out(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.kept for r in crf.quality(docs, labels.where("doc_id % 2 = 0")).collect()}
    other = [(got[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 1").collect()]
    assert sum(k == bool(q) for k, q in other) / len(other) >= 0.85
    none = crf.quality(frame(spark, [(1, None), (None, "a b c d e f g h i j k")]), labels.limit(0)).collect()
    assert len(none) == 2 and not any(r.kept for r in none)


def test_toxicity_holds_out(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(600):
        words = [f"w{rng.randrange(300)}" for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(30)] = rng.choice(["awful", "Horrid!", "nastylich", "nastyung"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic), 1))
    docs, labels = frame(spark, [*rows, (None, None), (700, "")], "doc_id bigint, text string, severity double, kept string"), frame(spark, marks, "doc_id bigint, toxic int, quality int")
    model = ordinal.train(docs, labels.where("doc_id < 400"))
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r for r in ordinal.severity(docs, model).collect()}
    held = [(got[i].toxic, i % 5 == 0) for i in range(400, 600)]
    assert sum(a == b for a, b in held) >= 190 and len(got) == 602 and got[None].kept and got[700].kept
    assert all(0 <= r.severity <= 2 and r.p_mild >= r.p_severe for r in got.values())
    blank = ordinal.train(docs.limit(0), labels)
    assert ordinal.severity(docs.limit(0), blank).collect() == [] and not any(r.toxic for r in ordinal.severity(docs, blank).collect())
