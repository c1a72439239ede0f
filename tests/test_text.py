import hashlib
import random

from pyspark.sql import functions as F

from docloom.functions import metadata, text, titles
from docloom.functions.citations import cited_numbers, numbered_sections
from docloom.functions.merkle import merkle_root
from docloom.functions.vectors import cosine, embed_texts, mean_vectors, unit


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_and_normalisation(spark):
    assert one(spark, text.estimate_tokens(F.lit(""))) == 1
    assert one(spark, text.estimate_tokens(F.lit("a" * 400))) == 100
    assert one(spark, text.normalize(F.lit("  A b\t\nC "))) == "a b c"
    expected = "7:" + hashlib.sha1(b"a b").hexdigest()[:16]
    assert one(spark, text.chunk_id(F.lit(7), F.lit(" A  b"))) == expected


def test_shingles(spark):
    assert one(spark, text.shingles(F.lit("one two three four five six"))) == ["one two three four five", "two three four five six"]
    assert one(spark, text.shingles(F.lit("Just Two"))) == ["just two"]
    assert one(spark, text.shingles(F.lit("  "))) == []


def test_analyzers(spark):
    assert one(spark, text.standard_terms(F.lit("Über-Mut 会议"))) == ["über", "mut", "会", "议"]
    assert one(spark, text.plain_terms(F.lit("Über Straße"))) == ["uber", "strasse"]
    assert one(spark, text.cjk_terms(F.lit("ab 会议记录 会"))) == ["ab", "会议", "议记", "记录", "会"]
    assert one(spark, text.edge_grams(F.array(F.lit("abc"), F.lit("x")))) == ["ab", "abc"]
    assert one(spark, text.char_grams(F.array(F.lit("abcd")))) == ["abc", "bcd"]
    assert one(spark, text.term_shingles(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == ["a", "b", "c", "a b", "b c", "a b c"]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_fuzzy_matches_equal_brute_force(spark):
    from docloom.operators.retrieval import fuzzy_terms

    random.seed(5)
    words = sorted({"".join(random.choices("abc", k=random.randint(1, 9))) for _ in range(400)})
    asked = words[::7] + ["abcabcabc", "b", "cab"]
    limit = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    expected = {(a, w, levenshtein(a, w)) for a in set(asked) for w in words if levenshtein(a, w) <= limit(a)}
    made = fuzzy_terms(spark.createDataFrame([(w,) for w in words], "t string"), spark.createDataFrame([(a,) for a in asked], "t string"))
    assert {tuple(r) for r in made.collect()} == expected


def root(ids):
    if not ids:
        return hashlib.sha256(b"").hexdigest()
    level = [hashlib.sha256(i.encode()).digest() for i in ids]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].hex()


def test_merkle_root(spark):
    lists = [[f"c{i}" for i in range(n)] for n in (0, 1, 2, 3, 5, 8, 13, 40, 257)]
    rows = spark.createDataFrame([(ids,) for ids in lists], "ids array<string>").select("ids", merkle_root(F.col("ids")).alias("r")).collect()
    assert all(r["r"] == root(r["ids"]) for r in rows)


def test_dates(spark):
    cases = {
        "2024-03-05": "2024-03-05", "2024/3/5T10:00": "2024-03-05", "5.3.24": "2024-03-05", "31/02/2024": None, "5th March, 2024": "2024-03-05",
        "Mac 3rd 2024": "2024-03-03", "3 ogos 21": "2021-08-03", "foo 3 2024": None, "n/a": None, "": None, "12-Dis-2020": "2020-12-12",
    }
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select("v", metadata.normalize_date(F.col("v")).alias("d")).collect()
    assert {r["v"]: r["d"] for r in rows} == cases


def test_model_reply(spark):
    replies = [
        ('```json\n{"title":"A  b","doctype":"Procedure","tags":"x; X, y,null","effective_date":"1 Jan 24","language":"BM"}``` bye',),
        ('well {"title": [1], "tags": ["p", "P ", 3]} tail',), ("nothing",),
    ]
    made = metadata.with_enrichment(spark.createDataFrame(replies, "v string"), "v").select("v", "enriched.*").collect()
    first = made[0]
    assert (first["title"], first["doctype"], first["effective_date"], first["language"], first["tags"]) == ("A b", "sop", "2024-01-01", "ms", ["x", "y"])
    assert made[1]["title"] is None and made[1]["tags"] == ["p", "3"]
    assert made[2]["doctype"] == "other" and made[2]["tags"] == []


def test_doctype(spark):
    cases = {"annual_report.pdf": "report", "Minutes-of.docx": "minutes", "会议记录.docx": "minutes", "policy on report": "policy", "reporting": None, "SOP v2": "sop"}
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select("v", metadata.infer_doctype(F.col("v")).alias("d")).collect()
    assert {r["v"]: r["d"] for r in rows} == cases
    assert one(spark, metadata.earliest_doctype(F.lit("the report of a meeting"))) == "report"


def block(kind, body, order, page=1, size=None):
    return F.struct(
        F.lit(order).alias("order"), F.lit(kind).alias("type"), F.lit(body).alias("text"), F.lit(page).alias("page"), F.lit(1).alias("level"),
        F.lit(size).cast("double").alias("font_size"),
    )


def test_title_cascade(spark):
    heading = F.array(block("paragraph", "x", 0), block("heading", "12 March 2024", 1), block("heading", "Leave  Policy", 2))
    printed = F.array(block("paragraph", "Big Print", 1, size=20.0), block("paragraph", "small", 2, size=9.0), block("paragraph", "more", 3, size=30.0))
    suggest = lambda e, b, f: one(spark, titles.suggest_title(F.lit(e).cast("string"), b, F.lit(f))).asDict()
    assert suggest("Real  Title", heading, "a.docx") == {"title": "Real Title", "source": "metadata", "confidence": 0.9}
    assert suggest("Microsoft Word - x", heading, "a.docx")["title"] == "Leave Policy"
    assert suggest("scan_001", printed, "a.docx") == {"title": "Big Print", "source": "heading", "confidence": 0.75}
    nothing = F.filter(heading, lambda b: F.lit(False))
    assert suggest(None, nothing, "dir/hr_LEAVE-form.v2.docx") == {"title": "Hr LEAVE Form V2", "source": "filename", "confidence": 0.4}
    assert suggest(None, nothing, "123.pdf") == {"title": "Untitled document", "source": "default", "confidence": 0.0}


def test_citation_marks_and_budget(spark):
    assert one(spark, cited_numbers(F.lit("[1] a [2, 3] b [1] [x]"))) == [1, 2, 3]
    assert one(spark, numbered_sections(F.array(F.lit(" abc "), F.lit("defgh"), F.lit("x")), 6)) == "[1]\nabc\n\n[2]\ndef"


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 1.0])], "k int, v array<double>")
    mean = mean_vectors(rows, ["k"], "v").first()["mean_vector"]
    assert [round(x, 6) for x in mean] == [0.666667, 0.666667]
    assert [round(x, 6) for x in one(spark, unit(F.array(F.lit(3.0), F.lit(4.0))))] == [0.6, 0.8]
    assert one(spark, cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_embedding_rule():
    vector = embed_texts(["Alpha beta", "", "!!"], 1000)
    h = int(hashlib.md5(b"alpha beta").hexdigest(), 16)
    assert vector[0][h % 1000] != 0 and (vector[0][h % 1000] > 0) == bool((h >> 64) & 1)
    assert vector[1][int(hashlib.md5(b"").hexdigest(), 16) % 1000] == 1.0
    assert abs((vector[0] ** 2).sum() - 1) < 1e-9


def test_context_budget_is_linear_in_the_lines(spark, tmp_path):
    """Counting the sections of a document took every line as often as it has lines after it: minutes for these rows."""
    from time import monotonic

    from docloom.plans import QUERIES

    rows = [(1, "\n".join([" a "] * 20_000)), (2, "x" * 999 + "\ny\n\nz"), (3, "\n\n"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    started = monotonic()
    got = {r.doc_id: r.n_sections for r in QUERIES["context_budget"](spark, str(tmp_path)).collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: 1000, 2: 2, 3: 3} and monotonic() - started < 60
