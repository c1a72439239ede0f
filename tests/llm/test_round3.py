"""Personal data, conversation prefixes and vector codes against brute force."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from docloom.llm import codes, prefixes, private

# Patterns of the contract, as written there.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        for found in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", found[0])
            fine = [True, all(int(p) <= 255 for p in found[0].split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][kind]
            if fine:
                out.append((found.start(), kind, found.end()))
    return sorted(out)


def test_patterns_match_the_contract():
    rng = random.Random(4)
    pieces = ["a", "B9", ".", "@", "-", "+", " ", "(", ")", "_%", "1", "22", "255", "256", "4000", "é", "x.y", "\n", "0001", "4111111111111111", "+1 (017) 555-7713", "1.2.3.4", "a@b.c"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30)))
        assert [s[:3] for s in private.base_spans(text)] == plain_spans(text), text
    began = time.perf_counter()
    for long in ("a" * 500000, "1" * 500000, "a." * 250000 + "@", "1." * 250000, "+1" * 250000, "@a" * 250000, "a@b" * 150000, "1 " * 250000):
        private.base_spans(long)
    assert time.perf_counter() - began < 15


SCHEMA = "doc_id bigint, text string, row binary, term string, kinds int"


def corpus():
    rng = random.Random(8)
    words = [f"w{k:03d}x" for k in range(300)]
    rows, number = [], 0

    def add(text):
        nonlocal number
        rows.append((number, text))
        number += 1

    for k in range(60):
        add(" ".join(rng.choice(words) for _ in range(30)))
    for k in range(5):  # a telling nickname near one address, in different contexts
        around = [rng.choice(words) for _ in range(24)]
        add(" ".join([*around[:12], "zorro", "Mail", "ann@example.org,", *around[12:]]) + " far away zorro said Émile")
    copy = "alone quiet 10.1.2.3 hidden " + " ".join(words[:20])
    for k in range(4):  # copies are one context
        add(copy)
    for k in range(9):  # without another word, even the class of the telling number is told
        add(f"{' '.join(rng.choice(words) for _ in range(12))} {5000 + k} 7788x +1 (017) 555-7713")
    add(None)
    add("")
    add("  \n ")
    rows.append((3, rows[60][1]))
    rows.append((None, rows[61][1]))
    rows.append(rows[62])
    return rows


def plain_terms(rows, window, contexts, disclosure):
    """Spans of terms by document, counted with dictionaries."""

    def terms(text):
        found = [(m.start(), m.end(), re.sub("[A-Z]", lambda c: c[0].lower(), m[0]), m[0]) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
        kind = lambda raw: "number" if re.fullmatch("[0-9]+", raw) else "code" if re.search("[0-9]", raw) else "name" if re.match("[A-Z]", raw) else "word"
        return [(a, b, t, "\0" + kind(raw)) for a, b, t, raw in found]

    number, seen, mentions = {}, {}, []
    for _, text in rows:
        for t in {x for term in terms(text or "") for x in term[2:]}:
            number[t] = number.get(t, 0) + 1
    for at, (_, text) in enumerate(rows):
        text = text or ""
        spans = plain_spans(text)
        free = [t for t in terms(text) if not any(t[0] < b and t[1] > a for a, _, b in spans)]
        for a, k, b in spans:
            left, right = [t for t in free if t[1] <= a][-window:], [t for t in free if t[0] >= b][:window]
            entity = (k, text[a:b].lower() if k == 0 else re.sub("[^0-9.]" if k == 1 else "[^0-9]", "", text[a:b]))
            seen.setdefault(entity, set()).add(tuple(t[2] for t in left + right))
            mentions.append((at, entity, left + right, free))
    told = {}
    for at, entity, near, _ in mentions:
        held = {}
        for k in range(len(mentions)):
            if mentions[k][1] == entity:
                held[tuple(t[2] for t in mentions[k][2])] = {x for t in mentions[k][2] for x in t[2:]}
        bits = math.log2(len(rows) / len(held))
        for t in {x for term in near for x in term[2:]}:
            both = sum(t in h for h in held.values())
            if len(held) >= contexts and both >= contexts and bits > 0 and 1 + math.log2(both / max(number[t], both)) / bits >= disclosure:
                told[entity, t] = True
    out = [set() for _ in rows]
    for at, entity, near, free in mentions:
        for _, _, t, _ in near:
            if (entity, t) in told:
                out[at] |= {(a, b, (entity, c) in told) for a, b, x, c in free if x == t}
    return [sorted(s) for s in out]


def test_disclosing_terms_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, None, "t", 5) for r in rows], SCHEMA)
    for window, contexts, disclosure in ((10, 3, 0.8), (4, 2, 0.5)):
        got = private.find(docs, window, contexts, disclosure).collect()
        ours = sorted(((r.doc_id is None, r.doc_id, list(zip(r.starts, r.kinds, r.stops)), [(t.start, t.stop, t.removed) for t in r.terms]) for r in got), key=repr)
        theirs = sorted(((r[0] is None, r[0], plain_spans(r[1] or ""), t) for r, t in zip(rows, plain_terms(rows, window, contexts, disclosure))), key=repr)
        assert ours == theirs
    assert sum(len(r.terms) for r in private.find(docs).collect()) > 10
    assert private.find(docs.limit(0)).collect() == []


def test_sanitised_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, None, "t", 5) for r in rows], SCHEMA)
    got = private.sanitised(docs).collect()
    assert len(got) == len(rows) and sum(r.text is None for r in got) == 1
    by_id = {r.doc_id: r.text for r in got if r.doc_id not in (3, None)}
    assert "[WORD]  [EMAIL]," in by_id[61] and by_id[61].endswith("far away [WORD] said Émile") and "zorro" not in by_id[61]
    assert by_id[5] == rows[5][1] and by_id[65] == rows[65][1].replace("10.1.2.3", "[IP]")
    assert "7788x" not in by_id[70] and "[PHONE]" in by_id[70]


def test_registered_digests(spark, small):
    import duckdb

    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())
    got = private.op11(spark, small).collect()
    assert len(got) == len(texts)
    for row in got:
        spans = plain_spans(texts[row.doc_id] or "")
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        said = ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert row.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and (row.n_terms or row.spans == said)


def plain_trie(rows, heads=6, stride=100):
    convs = {}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest()))
    for conv, _, role, text in order:
        convs.setdefault(conv, []).append((role or "", text or ""))
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(convs.get(c - int(math.fmod(c, stride)), [])[:h] + own[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        parents = {p[:-1] for p in nodes if p}
        out.append((
            min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), sum(len(p) == len(prefix) + 1 for p in below), sum(p not in parents for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(",".join(map(str, sorted(c for c in members if len(built[c]) == len(prefix)))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 205, 301, 1000000, -7, -200]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "ho é", "", None])) for t in range(rng.randrange(1, 7))]
    rows += [(100, t, "user", f"long {t}") for t in range(10, 40)] + [(117, t, "user", f"long {t}") for t in range(10, 45)]
    rows += [(5, None, None, None), (5, None, "user", "x"), (7, 0, "user", "hi"), (7, 0, "user", "hi"), (None, 0, "user", "lost"), (9, 1, "user", "y" * 100000)]
    return rows


@pytest.mark.parametrize("seed, height", [(1, 16), (2, 2), (3, 3)])
def test_prefix_trie_against_brute_force(spark, monkeypatch, seed, height):
    monkeypatch.setattr(prefixes, "CHUNK_CHARS", 8)
    rows = conversations(seed)
    frame = spark.createDataFrame([(*r, 3, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, p int, key string").repartition(3)
    got = sorted((tuple(r) for r in prefixes.trie(frame, height).collect()), key=repr)
    assert got == plain_trie(rows)
    if height == 16:
        assert prefixes.trie(frame.limit(0)).collect() == []


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = -(-max(len(r[1]) for r in kept) // parts)
    vectors = [[math.floor(256 * x) for x in r[1]] + [0] * (size * parts - len(r[1])) for r in kept]
    cut = [[tuple(v[p * size : (p + 1) * size]) for v in vectors] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for part in cut[p]:
                groups.setdefault(best(part, books[p])[1], []).append(part)
            for k, members in groups.items():
                books[p][k] = [sum(x) // len(members) for x in zip(*members)]
    coded = []
    for i, row in enumerate(kept):
        found = [best(cut[p][i], books[p]) for p in range(parts)]
        coded.append((row[0], row[2], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    total = {}
    for _, label, _, error in coded:
        total[label] = total.get(label, 0) + error
    return sorted(((v, c, e, total[label]) for v, label, c, e in coded), key=repr), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("length, count", [(64, 200), (32, 40), (40, 120)])
def test_codes_against_brute_force(spark, monkeypatch, length, count):
    monkeypatch.setattr(codes, "WALK", 7)
    rng = random.Random(length)
    grid = [-0.5, -0.25, 0.0, 0.125, 0.3, 1.7, -3.01]
    rows = [(i, [float(np.float32(rng.choice(grid))) for _ in range(length)], rng.choice([None, 0, 1, 2])) for i in range(count)]
    rows += [(7, rows[7][1], 1), rows[8], (None, rows[9][1], 1), (-3, [1.0] * length, None), (900, None, 1), (901, [math.nan] * length, 1), (902, [None] + [1.0] * (length - 1), 1), (903, [math.inf] * length, 2)]
    if length == 40:
        rows += [(500, [0.5] * 10, 1), (501, [], 2)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, entry int, code string").repartition(3)
    coded, books = codes.compress(frame)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in codes.with_label_error(coded).collect()), key=repr)
    assert (got, codes.digest(books)) == plain_codes(rows)
    empty, books = codes.compress(frame.limit(0))
    assert codes.with_label_error(empty).collect() == [] and books.size == 0


def test_shared_distances_equal_plain_ones():
    rng = np.random.default_rng(5)
    parts, leaf, weight = codes.leaves(rng.integers(-3, 3, (30000, 5)))
    book = rng.integers(-3, 3, (20, 5))
    plain = ((parts[:, None, :] - book[None]) ** 2).sum(2)
    entry, distance = codes.nearest(parts, book)
    assert (entry == plain.argmin(1)).all() and (distance == plain.min(1)).all() and weight.sum() == 30000
