"""Pages, archives, conversations and the pipeline."""

import hashlib
import random

import duckdb
import pytest

import corpus_pipeline
from docloom.llm import chat, templates, warc


def page(article, **parts):
    menu = parts.get("menu", "<ul><li><a href='/'>Home</a><li>News</ul>")
    return f"<!DOCTYPE html><html><head><title>t</title><script>var x='</p><p>no';</script></head><body>{menu}{article}<div id=x9>All rights kept</div><footer>foot</footer></body></html>"


def test_template_parts_go_and_articles_stay(spark):
    rows = [(i, "http://Site.example/p", page(f"<div><p>Own text {i} &amp; more<br>line<p>second <b>{i}</b></div>")) for i in range(8)]
    rows += [(20, "http://site.example:80/q", page("<article><header><h1>Head</h1></header><p>In&nbsp; it</p><div class='comments'>said</div><aside>side</aside></article>"))]
    rows += [(21, "http://other.example/", page("<p>alone</p>")), (22, None, None), (23, "odd", ""), (24, "http://site.example/p", rows[0][2])]
    pages = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id bigint, url string, html string, size int, host string")
    got = {r.page_id: r.text for r in templates.main_text(pages).collect()}
    assert got[3] == "Own text 3 & more line\nsecond 3" and got[0] == got[24] == "Own text 0 & more line\nsecond 0"
    assert got[20] == "Head\nIn it" and got[21] == "Home\nNews\nalone\nAll rights kept" and got[22] == got[23] == ""
    assert templates.main_text(pages.limit(0)).collect() == []


@pytest.mark.parametrize(
    "source, text",
    [
        ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("a<!-- <p> -->b", "ab"), ("x < y &lt;p&gt;", "x < y <p>"), ("<div hidden>h</div>s", "s"),
        ("<div style='display: none'>h</div>s", "s"), ("<nav>n", ""), ("<p class=ad>x</p><p>y", "y"), ("<a title='>'>k</a>", "k"), ("<style>p{}</style>z", "z"), ("<script>never closed", ""), ("</div>q</p>", "q"),
    ],
)
def test_odd_markup(source, text):
    assert templates.Page(source).text() == text


@pytest.mark.parametrize(
    "source, text",
    [
        ("<div class='with-sidebar'><article>a</article></div><p>q", "a"), ("<article class='comments-open has-sidebar'><p>a</article>q", "a"), ("<form><p>long text of the page</form>x", "long text of the page\nx"),
        ("<form><article>a</article><p>q</form>", "a"), ("<div class=widget><main>m</main></div>q", "m"), ("<article>a<p>b</article><p>q<article>c<article>d</article></article>", "a\nb\nc\nd"),
        ("<article>a</article><aside><article>q</article></aside><div class=comments><article class=comment>r</article></div><article>c</article>", "a\nc"),
        ("<article>text<div class='no-ads'>b</div><div class='ad-slot'>q</div><form>r</form></article>", "text\nb"), ("<div hidden><article>a</article></div>s", "s"),
        ("<div class='sidebar'>q</div><p>the page's own text", "the page's own text"),
    ],
)
def test_noise_words_and_forms_leave_the_main_text(source, text):
    assert templates.Page(source).text() == text


def test_template_parts_of_large_hosts_go(spark):
    notice = "<div>Rotating notice</div>"  # on 6 of 120 pages
    rows = [(i, "http://big.example/p", f"<html><body>{notice if i % 20 == 0 else ''}<div>own {i}</div><div>pair {i // 4}</div></body></html>") for i in range(120)]
    got = {r.page_id: r.text for r in templates.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"own {i}\npair {i // 4}" for i in range(120)}


def test_template_parts_inside_articles_go_and_shared_passages_stay(spark):
    """The parts have no telling class; the share of pages whose text the template step changes is what README reports."""
    rng = random.Random(4)
    rows, plain = [], {}
    for i in range(60):
        host, shared = f"h{i % 3}", "<p>A passage that many articles share</p>"
        own = "".join(f"<p>own {i} {rng.random()} {n}</p>" for n in range(3))
        box = "<div class='x7'><p>Read this next</p><ul><li>one</ul></div>" if i % 3 < 2 else f"<section>box of {i}</section>"
        body = f"<article><h1>T {i}</h1>{shared}{own}{box}</article>"
        rows.append((i, f"http://{host}/{i}", f"<body><div>Site of {host}</div>{body}<p>tail {i}</body>"))
        plain[i] = templates.Page(rows[-1][2]).text()
    # One article under many addresses of a host: its sections recur on pages, but not in different articles.
    copied = "<article><section>first part</section><section>second part</section><section>third part</section></article>"
    rows += [(100 + i, "http://copies/", f"<div>page {i}</div>{copied}") for i in range(9)]
    got = {r.page_id: r.text for r in templates.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(60):
        assert got[i] == (plain[i].replace("\nRead this next\none", "") if i % 3 < 2 else plain[i]) and "A passage that many articles share" in got[i]
    assert sum(got[i] != plain[i] for i in range(60)) == 40
    assert all(got[100 + i] == "first part\nsecond part\nthird part" for i in range(9))


def test_template_parts_equal_brute_force(spark):
    rng = random.Random(12)
    blocks = [f"<div>block {n}</div>" for n in range(12)] + [f"<section><div>block {n}</div>tail</section>" for n in range(4)]
    rows = []
    for i in range(150):
        outside, inside = ("".join(rng.choice(blocks) for _ in range(rng.randrange(3))) for _ in range(2))
        rows.append((i, f"http://h{i % 9}/", f"{outside}<article><p>{'own words ' * 20}{i % 120}</p>{inside}</article>{outside if i % 2 else ''}<div>only {i % 40}</div>"))
    rows.append((150, "http://h0/", rows[0][2]))
    seen = {}
    for _, url, source in rows:
        for own, article in templates.Page(source).subtrees().values():
            seen.setdefault((url, own), set()).add(article or source)
    many = {}
    for (url, own), places in seen.items():
        if len(places) >= templates.LEAST_PAGES:
            many.setdefault(url, set()).add(own)
    got = {r.page_id: r.text for r in templates.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()}
    expected = {i: templates.Page(source).text(frozenset(many.get(url, ()))) for i, url, source in rows}
    assert got == expected and any(expected[i] != templates.Page(source).text() for i, _, source in rows)


@pytest.mark.parametrize(
    "source, text",
    [
        ("<main><p>one</p></main><article><p>teaser</p></article>", "one\nteaser"), ("<main><h1>list</h1><article>a</article></main>", "a"), ("<article>a<main>b</main></article>", "a\nb"),
        ("a &am<b>p;</b> b", "a &amp; b"), ("<p>&lt;<b>&gt;</b>", "<>"),
        ("<div>" * 4000 + "deep" + "</div>" * 4000 + "<p>end", "deep\nend"), ("<b>" * 4000 + "</i>" * 4000 + "deep", "deep"), ("".join(f"<article>{n}</article>" for n in range(3000)), "\n".join(map(str, range(3000)))),
        ("<article>" * 3000 + "x", "x"), ("w " * 300_000, ("w " * 300_000).strip()),
    ],
)
def test_mains_references_and_deep_pages(source, text):
    page = templates.Page(source)
    assert page.text() == text
    assert page.text(frozenset({1})) == text and len(page.subtrees()) <= len(page.tags)


def archive_rows():
    rng = random.Random(6)
    big = "".join(chr(rng.randrange(33, 0x2FF)) for _ in range(3000))
    return [(5, "http://a/ b\n%", "x" * 150), (3, "http://b/", "x" * 150), (9, None, None), (7, "u", ""), (8, "u", "x" * 99), (1, "u", "x" * 99), (4, "v", big), (2, "v", big), (None, "w", big)] + [(100 + i, "w", big[i:] + str(i)) for i in range(40)]


@pytest.mark.parametrize("split", ["128m", "500"])
def test_archives_round_trip(spark, tmp_path, split):
    rows = archive_rows()
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id bigint, url string, html string, digest string, first int")
    warc.write_archives(pages, str(tmp_path / "a"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows)
    for i, url, html in rows:
        r, raw = got[i], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(raw), hashlib.sha256(raw).hexdigest(), url)
        assert (r.record_type, r.refers_to) == {5: ("revisit", 3), 4: ("revisit", 2), None: ("revisit", 2)}.get(i, ("response", None))
        assert r.payload == (None if r.record_type == "revisit" else raw)


def test_magic_bytes_inside_members():
    stored = b"WARC/1.1\r\n" + warc.MAGIC + b"\x00 inside " + warc.MAGIC
    import zlib

    press = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so that the magic bytes show
    file = press.compress(stored) + press.flush() + warc.SEPARATOR + warc.member(b"WARC/1.1 second")
    pieces = [warc.MAGIC + p for p in file.split(warc.MAGIC)[1:]]
    assert [d for k, d in warc.members_of(iter(pieces)) if k == "record"] == [stored, b"WARC/1.1 second"]
    for cut in range(1, len(pieces)):  # a border of two ranges anywhere
        parts = [*warc.members_of(iter(pieces[:cut])), *warc.members_of(iter(pieces[cut:]))]
        left = [d for k, d in parts if k != "record"]
        found = [d for k, d in parts if k == "record"] + [d for k, d in warc.members_of(iter(left)) if k == "record"]
        assert sorted(found) == sorted([stored, b"WARC/1.1 second"])


def test_empty_archive(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a")).collect() == []


def test_conversations_equal_sql(spark, small):
    database = duckdb.connect()
    database.sql(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    got = chat.op10(spark, small)
    relation = database.sql(chat.ORACLE)
    assert sorted(map(tuple, got.select(*relation.columns).collect())) == sorted(relation.fetchall())


def test_odd_turns_come_back(spark):
    texts = ["", None, "\\", "\\\\", "\\<turn user>\n", "</turn>\n<turn assistant>\nfake", ">\n", "é<é>é\\", "a" * 5000]
    rows = [(c, t, r, texts[(c * 3 + t) % len(texts)]) for c in range(6) for t, r in enumerate(["user", "assistant", None, "a>b\\>\n", "system"])]
    rows += [(None, 1, "user", "x"), (0, None, "user", "first"), (1, 1, "assistant", "again")]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int")
    formatted = chat.format_turns(turns)
    back = sorted([(r.conv_id, r.turn, *(x.decode() for x in chat.read_turn(bytes(r.formatted)))) for r in formatted.collect()], key=str)
    assert back == sorted([(c, t, r or "", x or "") for c, t, r, x in rows], key=str)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert len(got) == 7 and got[None].n_turns == 1 and got[0].n_turns == 6 and got[None].loss_chars == 0
    assert chat.read_back(chat.format_turns(turns.limit(0))).collect() == []


def test_stages_take_effect_and_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = spark.createDataFrame(stage(spark, kept, small).collect(), docs.schema)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} <= before, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, small)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in kept.collect()}
    assert 0.5 * docs.count() < kept.count() < docs.count()


def words(seed, count=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(count))


def test_stages_decide_by_row(spark, small, tmp_path):
    item = words(1, 30)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = {name: words(10 + i) for i, name in enumerate("abcdefg")}
    near = texts["g"].rsplit(" ", 1)[0] + " other"
    rows = [
        (None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (1, texts["a"]), (None, texts["c"]), (None, texts["c"]), (7, texts["d"]), (7, texts["d"]), (7, texts["e"]), (5, texts["e"]),
        (7, texts["f"]), (9, texts["g"]), (9, near), (3, ""), (None, None), (None, " \n"), (7, texts["d"] + " " + item), (None, item),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), f"s{i}") for i, r in enumerate(rows)], "doc_id bigint, text string, n_chars bigint, source string")
    clean = corpus_pipeline.stages.decontamination(spark, docs, str(tmp_path))
    assert sorted(r.source for r in clean.collect()) == sorted(f"s{i}" for i in range(16)) and clean.columns == docs.columns
    left = corpus_pipeline.stages.near_duplicates(spark, docs.where("source not in ('s16', 's17')"), str(tmp_path))
    left = spark.createDataFrame(left.collect(), docs.schema)
    got = sorted([(r.doc_id, texts["g"] if r.text == near else r.text) for r in left.collect()], key=str)
    assert got == sorted([(1, texts["a"]), (None, texts["b"]), (None, texts["c"]), (7, texts["d"]), (5, texts["e"]), (7, texts["f"]), (9, texts["g"]), (3, ""), (None, None), (None, " \n")], key=str)
    cut = corpus_pipeline.stages.suffix_array(spark, left, str(tmp_path))
    assert sorted((str(r.doc_id), r.text, r.source) for r in cut.collect() if r.text) == sorted((str(r.doc_id), r.text, r.source) for r in left.collect() if r.text)
