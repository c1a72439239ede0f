"""Registered queries: text scalars, hashing, duplicates, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import metadata, titles
from docloom.functions.citations import cited_numbers, numbered_sections
from docloom.functions.text import chunk_id, estimate_tokens, normalize, sentences, shingles, strip, words
from docloom.functions.vectors import hash_embedder
from docloom.operators import dedup, folders
from docloom.operators.chunking import unique_id
from docloom.plans import sqltext
from docloom.plans.corpus import VECTOR_DIM
from docloom.plans.registry import register
from docloom.sources.tables import spread, table


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


@register(
    "text_scalars",
    rf"""
SELECT doc_id, greatest(1, length(text) // 4) AS tokens, sha1({sqltext.normalize('text')}) AS text_hash, len({sqltext.words('text')}) AS n_words,
  len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){sqltext.WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: {sqltext.strip('s')}), lambda s: s <> '')) AS n_sentences
FROM documents
""",
)
def text_scalars(spark, folder):
    text = F.col("text")
    return documents(spark, folder).select(
        "doc_id", estimate_tokens(text).alias("tokens"), F.sha1(normalize(text).cast("binary")).alias("text_hash"),
        F.size(words(text)).alias("n_words"), F.size(sentences(text)).alias("n_sentences"),
    )


@register(
    "chunk_ids",
    f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS ord
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)),
ids AS (SELECT doc_id, ord, {sqltext.chunk_id('doc_id', 'line')} AS base FROM lines),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY ord) AS n FROM ids)
SELECT doc_id, ord, CASE WHEN n = 1 THEN base ELSE base || ':' || n END AS chunk_id FROM numbered
""",
)
def chunk_ids(spark, folder):
    lines = F.filter(F.split("text", "\n"), lambda l: F.trim(l) != "")
    ids = documents(spark, folder).select("doc_id", F.transform(lines, lambda l: chunk_id(F.col("doc_id"), l)).alias("ids"))
    return ids.select("doc_id", "ids", F.posexplode("ids").alias("ord", "_id")).select("doc_id", "ord", unique_id(F.col("ids"), F.col("ord")).alias("chunk_id"))


@register(
    "exact_duplicates",
    """
WITH firsts AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate_of FROM documents)
SELECT doc_id, duplicate_of FROM firsts WHERE doc_id <> duplicate_of
""",
)
def exact_duplicates(spark, folder):
    return dedup.exact_duplicates(table(spark, folder, "documents"), "doc_id")


@register("shingles", f"WITH {sqltext.SHINGLES} SELECT doc_id, len(s) AS n_shingles, md5(array_to_string(list_sort(s), '|')) AS shingle_hash FROM doc_shingles")
def shingle_sets(spark, folder):
    grams = documents(spark, folder).select("doc_id", shingles(F.col("text")).alias("s"))
    return grams.select("doc_id", F.size("s").alias("n_shingles"), F.md5(F.array_join(F.array_sort("s"), "|").cast("binary")).alias("shingle_hash"))


@register("minhash_signatures", f"WITH {sqltext.MINHASH} SELECT doc_id, md5(array_to_string(sig, ',')) AS signature_hash, sig[1] AS first_value, sig[128] AS last_value FROM sigs")
def minhash_signatures(spark, folder):
    signed = dedup.with_signatures(documents(spark, folder)).where(F.col("signature").isNotNull())
    joined = F.array_join(F.col("signature").cast("array<string>"), ",")
    return signed.select(
        "doc_id", F.md5(joined.cast("binary")).alias("signature_hash"), F.element_at("signature", 1).alias("first_value"),
        F.element_at("signature", 128).alias("last_value"),
    )


@register("minhash_bands", f"WITH {sqltext.MINHASH} SELECT doc_id, band, bucket FROM bands")
def minhash_bands(spark, folder):
    return dedup.band_rows(dedup.with_signatures(documents(spark, folder)), "doc_id")


_PAIRS = (
    sqltext.MINHASH
    + """,
pairs AS (SELECT DISTINCT a.doc_id, b.doc_id AS other FROM bands a JOIN bands b ON a.band = b.band AND a.bucket = b.bucket AND a.doc_id <> b.doc_id),
scored AS (
  SELECT p.doc_id, p.other, list_sum(list_transform(range(1, 129), lambda i: CASE WHEN x.sig[i] = y.sig[i] THEN 1 ELSE 0 END)) / 128.0 AS similarity
  FROM pairs p JOIN sigs x ON x.doc_id = p.doc_id JOIN sigs y ON y.doc_id = p.other)
"""
)


@register(
    "near_duplicates",
    f"""
WITH {_PAIRS},
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, other) AS n FROM scored)
SELECT doc_id, other AS duplicate_of, 'near' AS duplicate_tier, CAST(similarity AS DOUBLE) AS similarity FROM best WHERE n = 1 AND similarity >= 0.8
""",
)
def near_duplicates(spark, folder):
    return dedup.duplicate_tiers(documents(spark, folder), "doc_id")


@register(
    "duplicate_tiers",
    f"""
WITH {_PAIRS}, {sqltext.embedding('documents', 'doc_id', 'text')},
cos AS (
  SELECT s.doc_id, s.other, sum(x.x * y.x) AS c FROM scored s JOIN vec x ON x.k = s.doc_id JOIN vec y ON y.k = s.other AND y.slot = x.slot GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, other) AS n FROM scored),
near AS (SELECT doc_id, other AS duplicate_of, 'near' AS duplicate_tier, similarity FROM best WHERE n = 1 AND similarity >= 0.8),
close AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY similarity DESC, s.other) AS n
  FROM scored s JOIN cos c ON c.doc_id = s.doc_id AND c.other = s.other WHERE round(c.c, 9) >= 0.95 AND s.doc_id NOT IN (SELECT doc_id FROM near))
SELECT doc_id, duplicate_of, duplicate_tier, CAST(similarity AS DOUBLE) AS similarity FROM near
UNION ALL SELECT doc_id, other, 'semantic', CAST(similarity AS DOUBLE) FROM close WHERE n = 1
""",
)
def duplicate_tiers(spark, folder):
    embedded = documents(spark, folder).withColumn("vector", hash_embedder(VECTOR_DIM)("text"))
    return dedup.duplicate_tiers(embedded, "doc_id", vector="vector")


@register("hash_embedding", f"WITH {sqltext.embedding('documents', 'doc_id', 'text')} SELECT k AS doc_id, slot, round(x, 6) AS value FROM vec WHERE round(x, 6) <> 0")
def hash_embedding(spark, folder):
    embedded = documents(spark, folder).select("doc_id", hash_embedder(VECTOR_DIM)("text").alias("v"))
    values = embedded.select("doc_id", F.posexplode("v").alias("slot", "value"))
    return values.withColumn("value", F.round("value", 6)).where("value <> 0")


# --- metadata ----------------------------------------------------------------

_NAMES = ["minutes_of_board", "Pekeliling-Am", "SOP.claims", "garis_panduan_baru", "Policy", "laporan", "travel guidelines", "reporting_line", "HR memo"]
_NAMES_SQL = "([" + ", ".join(f"'{n}'" for n in _NAMES) + "])[doc_id % 9 + 1]"


def _filename() -> F.Column:
    return F.concat(F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.pmod("doc_id", F.lit(9)) + 1).cast("int")), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".docx"))


def _doctype_sql(text: str) -> str:
    rows = "lower(" + text + ")"
    spaced = rf"regexp_replace({rows}, '[_\-.]+', ' ', 'g')"
    cases = []
    for doctype, (whole, anywhere) in metadata.DOCTYPE_WORDS.items():
        pattern = rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(whole)})(?:$|[^\p{{L}}\p{{N}}_])" + "".join("|" + a for a in anywhere)
        cases.append(f"WHEN regexp_matches({spaced}, '{pattern}') THEN '{doctype}'")
    return "CASE " + " ".join(cases) + " END"


@register(
    "infer_doctype",
    f"""
WITH named AS (SELECT doc_id, text, {_NAMES_SQL} || '_' || doc_id || '.docx' AS filename FROM documents)
SELECT doc_id, {_doctype_sql('filename')} AS from_name, coalesce({_doctype_sql('split_part(text, chr(10), 1)')}, {_doctype_sql('filename')}, {_doctype_sql('substr(text, 1, 600)')}, 'other') AS doctype
FROM named
""",
)
def infer_doctype(spark, folder):
    named = documents(spark, folder).select("doc_id", "text", _filename().alias("filename"))
    first_line = F.get(F.split("text", "\n"), 0)
    return named.select(
        "doc_id", metadata.infer_doctype(F.col("filename")).alias("from_name"),
        metadata.resolve_doctype(F.lit("other"), first_line, F.col("filename"), F.col("text")).alias("doctype"),
    )


@register(
    "normalize_dates",
    """
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS effective_date FROM orders
""",
)
def normalize_dates(spark, folder):
    """Order dates written in eight spellings (two of them not dates) and read back."""
    day = F.col("o_orderdate")
    ordinal = F.concat(F.date_format(day, "d"), F.when(F.dayofmonth(day).isin(1, 21, 31), "st").when(F.dayofmonth(day).isin(2, 22), "nd").when(F.dayofmonth(day).isin(3, 23), "rd").otherwise("th"))
    spellings = [
        F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "d/M/yyyy"), F.concat(ordinal, F.date_format(day, " MMMM, yyyy")), F.date_format(day, "MMM d, yyyy"),
        F.date_format(day, "yyyy.M.d'T'HH:mm"), F.concat(F.date_format(day, "yyyy"), F.lit("-13-01")), F.lit("n/a"), F.upper(F.date_format(day, " dd-MMM-yyyy")),
    ]
    written = F.element_at(F.array(*spellings), (F.pmod("o_orderkey", F.lit(8)) + 1).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", metadata.normalize_date(written).alias("effective_date"))


@register(
    "clean_metadata",
    """
SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'en' WHEN 'error' THEN 'zh' WHEN 'purchase' THEN 'ms' ELSE NULL END AS language,
  CASE event_type WHEN 'view' THEN 'sop' WHEN 'click' THEN 'policy' WHEN 'error' THEN 'other' WHEN 'purchase' THEN 'minutes' ELSE 'report' END AS doctype,
  CASE WHEN event_type = 'click' THEN 'Click|x' ELSE event_type || '|x' END AS tags
FROM events
""",
)
def clean_metadata(spark, folder):
    kind = F.col("event_type")

    def pick(values):
        chosen = F.lit(values[None])
        for name, value in values.items():
            if name:
                chosen = F.when(kind == name, value).otherwise(chosen)
        return chosen

    language = pick({"view": "null", "click": " English ", "error": "ZH-CN", "purchase": "bm", None: "klingon"})
    doctype = pick({"view": "Standard  Operating Procedure", "click": "POLICY", "error": "n/a", "purchase": "minit", None: "report"})
    first = F.when(kind == "click", "Click").otherwise(kind)
    tags = F.array(F.lit("none"), first, F.upper(kind), F.concat(F.lit(" "), kind), F.lit("x"), F.lit(None).cast("string"))
    return table(spark, folder, "events").select(
        "event_id", metadata.normalize_language(language).alias("language"), metadata.normalize_doctype(doctype).alias("doctype"),
        F.array_join(metadata.clean_tags(tags), "|").alias("tags"),
    )


@register(
    "auto_folder",
    """
WITH d AS (SELECT doc_id, (['policy','sop','circular','guideline','report','minutes','other'])[doc_id % 7 + 1] AS doctype,
  (['finance','hr','it'])[doc_id % 3 + 1] AS department, (2023 + doc_id % 5) AS y FROM documents)
SELECT doc_id, CASE WHEN doctype = 'policy' THEN 'policies' WHEN doctype = 'sop' AND department = 'finance' THEN 'sop-fin'
  WHEN doctype = 'sop' AND department = 'hr' THEN 'sop-hr' WHEN doctype = 'sop' THEN 'sops' WHEN doctype = 'circular' AND y = 2024 THEN 'circ-2024'
  WHEN doctype = 'circular' AND y = 2026 THEN 'circ-2026' WHEN doctype = 'circular' THEN 'circulars' WHEN doctype = 'guideline' THEN 'guidelines'
  WHEN doctype = 'report' THEN 'reports' WHEN doctype = 'minutes' THEN 'min-mgmt' ELSE 'inbox' END AS folder_id FROM d
""",
)
def auto_folder(spark, folder):
    d = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in ("policy", "sop", "circular", "guideline", "report", "minutes", "other")])
    rows = table(spark, folder, "documents").select(
        "doc_id", F.element_at(kinds, (F.pmod(d, F.lit(7)) + 1).cast("int")).alias("doctype"),
        F.element_at(F.array(F.lit("finance"), F.lit("hr"), F.lit("it")), (F.pmod(d, F.lit(3)) + 1).cast("int")).alias("department_id"),
        F.concat((F.pmod(d, F.lit(5)) + 2023).cast("string"), F.lit("-06-01")).alias("effective_date"), F.lit(None).cast("string").alias("folder_id"),
    )
    tree = spark.createDataFrame(folders.DEFAULT_FOLDERS, "folder_id string, name string, parent_id string")
    return folders.auto_file(rows, tree).select("doc_id", "folder_id")


@register(
    "folder_slugs",
    r"""
WITH s AS (SELECT doc_id, trim(substr(trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-') AS slug FROM documents)
SELECT doc_id, CASE WHEN slug = '' THEN 'folder' ELSE slug END AS slug FROM s
""",
)
def folder_slugs(spark, folder):
    return documents(spark, folder).select("doc_id", folders.slug(F.get(F.split("text", "\n"), 0)).alias("slug"))


@register(
    "title_cascade",
    rf"""
WITH d AS (
  SELECT doc_id, {_NAMES_SQL} || '_' || doc_id || '.docx' AS filename, {_NAMES_SQL} || '_' || doc_id AS stem, {sqltext.collapse('split_part(text, chr(10), 1)')} AS line,
    CASE doc_id % 3 WHEN 0 THEN 'Microsoft Word - x' WHEN 1 THEN 'Annual  plan ' || doc_id ELSE NULL END AS embedded FROM documents),
n AS (
  SELECT *, length(line) BETWEEN 3 AND 120 AND regexp_matches(line, '[\p{{L}}\p{{Nl}}\p{{No}}]') AS heading_ok,
    array_to_string(list_transform(string_split({sqltext.collapse("regexp_replace(stem, '[_.-]+', ' ', 'g')")}, ' '), lambda w:
      CASE WHEN upper(w) = w AND lower(w) <> w AND length(w) > 1 THEN w ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') AS from_name FROM d)
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'Annual plan ' || doc_id WHEN heading_ok THEN line ELSE from_name END AS title,
  CASE WHEN doc_id % 3 = 1 THEN 'metadata' WHEN heading_ok THEN 'heading' ELSE 'filename' END AS title_source,
  CAST(CASE WHEN doc_id % 3 = 1 THEN 0.9 WHEN heading_ok THEN 0.75 ELSE 0.4 END AS DOUBLE) AS confidence
FROM n
""",
)
def title_cascade(spark, folder):
    """The first line stands for the page's heading; one in three files carries a usable embedded title."""
    embedded = F.when(F.pmod("doc_id", F.lit(3)) == 0, "Microsoft Word - x").when(F.pmod("doc_id", F.lit(3)) == 1, F.concat(F.lit("Annual  plan "), F.col("doc_id").cast("string")))
    block = F.struct(
        F.lit(0).alias("order"), F.lit("heading").alias("type"), F.get(F.split("text", "\n"), 0).alias("text"), F.lit(1).alias("page"),
        F.lit(1).alias("level"), F.lit(None).cast("double").alias("font_size"),
    )
    chosen = documents(spark, folder).select("doc_id", titles.suggest_title(embedded, F.array(block), _filename()).alias("t"))
    return chosen.select("doc_id", "t.title", F.col("t.source").alias("title_source"), "t.confidence")


@register(
    "cited_numbers",
    r"""
WITH a AS (SELECT conv_id, turn, text || ' [' || (turn + 1) || '] and [' || (turn + 3) || ', ' || (turn + 1) || '] or [x] [' || conv_id || ']' AS answer FROM conversations),
m AS (SELECT conv_id, turn, regexp_extract_all(answer, '\[(\d+(?:\s*,\s*\d+)*)\]', 1) AS marks FROM a),
f AS (SELECT conv_id, turn, list_transform(flatten(list_transform(marks, lambda x: string_split(x, ','))), lambda x: CAST(trim(x) AS INTEGER)) AS n FROM m)
SELECT conv_id, turn, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), ',') AS numbers FROM f
""",
)
def cited(spark, folder):
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    answer = F.concat(
        F.col("text"), F.lit(" ["), (turn + 1).cast("string"), F.lit("] and ["), (turn + 3).cast("string"), F.lit(", "), (turn + 1).cast("string"),
        F.lit("] or [x] ["), conv, F.lit("]"),
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(cited_numbers(answer).cast("array<string>"), ",").alias("numbers"))


@register(
    "context_budget",
    f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
s AS (SELECT doc_id, i, {sqltext.strip('line')} AS t FROM lines),
b AS (SELECT *, 1000 - coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM s)
SELECT doc_id, md5(string_agg('[' || i || ']' || chr(10) || substr(t, 1, CAST(room AS BIGINT)), chr(10) || chr(10) ORDER BY i)) AS sections_hash,
  count(*) AS n_sections FROM b WHERE room > 0 GROUP BY doc_id
""",
)
def context_budget(spark, folder):
    lines = F.split("text", "\n")
    packed = documents(spark, folder).select("doc_id", numbered_sections(lines, 1000).alias("s"), lines.alias("l"))
    used = F.struct(F.lit(0).alias("sections"), F.lit(0).alias("chars"))
    counted = F.aggregate(
        "l", used,
        lambda done, x: F.struct((done["sections"] + (done["chars"] < 1000).cast("int")).alias("sections"), (done["chars"] + F.length(strip(x))).alias("chars")),
    )
    return packed.select("doc_id", F.md5(F.col("s").cast("binary")).alias("sections_hash"), counted["sections"].cast("long").alias("n_sections"))


@register(
    "offline_enrichment",
    r"""
WITH d AS (
  SELECT doc_id, ([
    'Circular KPT/ICT/2024/' || doc_id || chr(10) || 'Effective 2024-03-05. This replaces: KPT/ICT/2021/' || doc_id || chr(10),
    'Meeting notes' || chr(10) || 'see FIN/OPS/' || doc_id || chr(10), ''])[doc_id % 3 + 1] || text AS t, doc_id % 3 AS kind FROM documents)
SELECT doc_id, CASE kind WHEN 0 THEN 'circular' WHEN 1 THEN 'minutes' ELSE 'other' END AS doctype,
  CASE kind WHEN 0 THEN 'KPT/ICT/2024/' || doc_id WHEN 1 THEN 'FIN/OPS/' || doc_id END AS reference_no,
  CASE kind WHEN 0 THEN '2024-03-05' END AS effective_date, CASE kind WHEN 0 THEN 'KPT/ICT/2021/' || doc_id END AS supersedes_ref, 'en' AS language FROM d
""",
)
def offline_enrichment(spark, folder):
    number = F.col("doc_id").cast("string")
    lead = F.array(
        F.concat(F.lit("Circular KPT/ICT/2024/"), number, F.lit("\nEffective 2024-03-05. This replaces: KPT/ICT/2021/"), number, F.lit("\n")),
        F.concat(F.lit("Meeting notes\nsee FIN/OPS/"), number, F.lit("\n")),
        F.lit(""),
    )
    text = F.concat(F.element_at(lead, (F.pmod("doc_id", F.lit(3)) + 1).cast("int")), F.col("text"))
    read = documents(spark, folder).select("doc_id", metadata.offline_enrichment(text, F.lit("scan.docx")).alias("e"))
    return read.select("doc_id", *[f"e.{c}" for c in ("doctype", "reference_no", "effective_date", "supersedes_ref", "language")])

