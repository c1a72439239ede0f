"""Registered queries: row changes, manifests, index rows, tags and folders, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.metadata import with_enrichment
from docloom.functions.titles import choose_title
from docloom.operators import access, catalog, centroids, enrich, folders, retrieval, versioning
from docloom.plans import sqltext
from docloom.plans.catalog_queries import _FOLDERS_SQL, _MANIFEST_SQL, _folders, _manifests
from docloom.plans.corpus import CATALOGUE_SQL, DOCUMENT_TAGS_SQL, GROUPS, GROUPS_SQL, catalogue, document_tags, search_index
from docloom.plans.registry import register
from docloom.session import cut_lineage, shared_folder
from docloom.settings import DEFAULTS
from docloom.sources import index_store
from docloom.sources.tables import table
from docloom.sources.versioned import Versioned

_NOW = "2025-01-01"

# --- manifests and index rows ------------------------------------------------


def _stored_chunks(spark, folder):
    """Manifest of the old version, and the chunks that the new version still holds."""
    both = _manifests(spark, folder)
    versions = both.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("version_id"), F.col("old_manifest").alias("chunk_manifest"))
    return versions, both.select(F.col("doc_id").alias("document_id"), F.explode("new_manifest").alias("chunk_id")).distinct()


@register(
    "manifest_chunks",
    f"""
WITH {_MANIFEST_SQL}, o AS (SELECT doc_id, new, unnest(old) AS chunk_id, generate_subscripts(old, 1) AS pos FROM m)
SELECT doc_id AS document_id, CAST(pos - 1 AS INTEGER) AS position, chunk_id FROM o WHERE list_contains(new, chunk_id)
""",
)
def manifest_chunks(spark, folder):
    """Chunks in manifest order; ids without a stored chunk are passed over."""
    versions, chunks = _stored_chunks(spark, folder)
    return versioning.manifest_chunks(versions.select("document_id", "chunk_manifest"), chunks).select("document_id", "position", "chunk_id")


@register(
    "passage_rows",
    f"""
WITH {_MANIFEST_SQL}, {CATALOGUE_SQL}, {DOCUMENT_TAGS_SQL},
o AS (SELECT doc_id, new, unnest(old) AS chunk_id FROM m),
p AS (
  SELECT doc_id AS document_id, chunk_id, 0 AS level, NULL AS summary FROM o WHERE list_contains(new, chunk_id)
  UNION ALL SELECT doc_id, 'root:' || doc_id, 1, lang FROM documents),
t AS (SELECT document_id, string_agg(tag_name, '|' ORDER BY tag_name) AS tags FROM (SELECT DISTINCT * FROM doc_tags) GROUP BY document_id)
SELECT p.document_id, p.chunk_id, p.level, p.summary, c.department_id, c.superseded_by IS NOT NULL AS superseded, coalesce(t.tags, '') AS tags, c.department_id AS groups
FROM p JOIN cat c USING (document_id) LEFT JOIN t USING (document_id) WHERE c.deleted_at IS NULL
""",
)
def passage_rows(spark, folder):
    """Index rows of live documents: current chunks below a summary node per document."""
    versions, chunks = _stored_chunks(spark, folder)
    stored = chunks.select(
        "document_id", "chunk_id", F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("heading_path"),
        F.lit(1).alias("page_from"), F.lit(None).cast("array<double>").alias("embedding"),
    )
    d = F.col("doc_id")
    nodes = table(spark, folder, "documents").select(
        d.alias("document_id"), F.concat(F.lit("root:"), d.cast("string")).alias("node_id"), F.lit(1).alias("level"), F.col("lang").alias("summary_text"),
        F.lit(None).cast("array<double>").alias("embedding"),
    )
    rows = index_store.passage_rows(catalogue(spark, folder), versions, stored, nodes, document_tags(spark, folder))
    return rows.select(
        "document_id", "chunk_id", "level", F.col("text").alias("summary"), "department_id", "superseded",
        F.array_join("tags", "|").alias("tags"), F.array_join("allowed_groups", "|").alias("groups"),
    )


@register(
    "replaced_passages",
    """
WITH old AS (SELECT o_custkey AS document_id, o_orderkey AS chunk_id, o_orderpriority AS text FROM orders WHERE o_orderstatus <> 'P'),
new AS (SELECT o_custkey AS document_id, o_orderkey AS chunk_id, 'new' AS text FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus <> 'O'),
both_ AS (SELECT * FROM old WHERE document_id NOT IN (SELECT document_id FROM new) UNION ALL SELECT * FROM new)
SELECT * FROM both_ WHERE document_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
""",
)
def replaced_passages(spark, folder):
    """Customers as documents, orders as passages: one segment's rows are replaced, then customers in debt leave the index."""
    orders, buyers = table(spark, folder, "orders"), table(spark, folder, "customer")
    key = [F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("chunk_id")]
    stored = orders.where("o_orderstatus <> 'P'").select(*key, F.col("o_orderpriority").alias("text"))
    segment = buyers.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    fresh = orders.where("o_orderstatus <> 'O'").join(segment, "o_custkey", "left_semi").select(*key, F.lit("new").alias("text"))
    gone = buyers.where("c_acctbal < 0").select(F.col("c_custkey").alias("document_id"))
    return index_store.delete_passages(index_store.upsert_passages(stored, fresh), gone)


@register(
    "index_postings",
    f"""
WITH {CATALOGUE_SQL},
toks AS (SELECT document_id, 0 AS field, {sqltext.terms('title')} AS t FROM cat UNION ALL SELECT document_id, 1, {sqltext.terms('text')} FROM cat),
words AS (SELECT document_id, field, len(t) AS length, unnest(t) AS term FROM toks),
p AS (SELECT field, term, document_id, length, count(*) AS tf FROM words GROUP BY ALL)
SELECT CAST(field AS INTEGER) AS field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(max(length) AS INTEGER) AS longest FROM p GROUP BY field, term
""",
)
def index_postings(spark, folder):
    """The inverted index, summed up per term."""
    rows = index_store.postings(retrieval.analyze_index(search_index(spark, folder).drop("embedding")))
    return rows.where("field < 2").groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"), F.max("length").alias("longest")
    )


@register(
    "document_vectors",
    """
WITH parts AS (SELECT vec_id % 100 AS document_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT document_id, i, avg(x) FILTER (WHERE label < 5 AND document_id % 3 <> 0) AS cur, avg(x) AS whole FROM parts GROUP BY ALL)
SELECT document_id, CAST(i - 1 AS INTEGER) AS pos, round(coalesce(cur, whole), 6) AS value FROM means
""",
)
def document_vectors(spark, folder):
    """Vectors as chunks of a hundred documents; a third of them have an empty manifest and fall back to all chunks."""
    chunks = table(spark, folder, "embeddings").select(
        F.pmod("vec_id", F.lit(100)).alias("document_id"), F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")
    )
    current = chunks.where((F.col("label") < 5) & (F.pmod("document_id", F.lit(3)) != 0)).select("document_id", "chunk_id")
    made = retrieval.document_vectors(chunks, current)
    return made.select("document_id", F.posexplode("vector").alias("pos", "v")).select("document_id", "pos", F.round("v", 6).alias("value"))


# --- catalogue changes -------------------------------------------------------


@register(
    "version_by_hash",
    """
WITH v AS (SELECT doc_id, sha256(text) AS sha256 FROM documents)
SELECT sha256, min(doc_id) AS document_id FROM v WHERE doc_id % 17 <> 0 GROUP BY sha256
""",
)
def version_by_hash(spark, folder):
    """The earliest live document with the same bytes, asked for by every document."""
    d = F.col("doc_id")
    versions = table(spark, folder, "documents").select(d.alias("document_id"), F.lit(1).alias("version_no"), d.alias("created_at"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    asked = versions.select("sha256")
    return catalog.version_by_hash(versions, catalogue(spark, folder), asked).select("sha256", "document_id")


@register(
    "soft_deleted_documents",
    f"""
WITH {CATALOGUE_SQL}
SELECT document_id, CASE WHEN deleted_at IS NULL AND document_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN TIMESTAMP '{_NOW}' ELSE deleted_at END AS deleted_at FROM cat
""",
)
def soft_deleted_documents(spark, folder):
    """Documents labelled toxic go; those deleted before keep their time."""
    toxic = table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return catalog.soft_delete(catalogue(spark, folder), toxic, F.lit(_NOW).cast("timestamp")).select("document_id", "deleted_at")


@register(
    "updated_documents",
    f"""
WITH {CATALOGUE_SQL}, c AS (SELECT DISTINCT doc_id, quality FROM labels)
SELECT document_id, CASE WHEN doc_id IS NULL THEN status WHEN quality = 1 THEN 'READY' ELSE 'FAILED' END AS status,
  CASE WHEN doc_id IS NULL THEN superseded_by WHEN quality = 0 THEN doc_id + 3 END AS superseded_by FROM cat LEFT JOIN c ON doc_id = document_id
""",
)
def updated_documents(spark, folder):
    """A partial update: labelled documents get a new status and successor (null overwrites too), the others stay."""
    d = F.col("doc_id")
    changes = table(spark, folder, "labels").select(
        d.alias("document_id"), F.when(F.col("quality") == 1, "READY").otherwise("FAILED").alias("status"), F.when(F.col("quality") == 0, d + 3).alias("superseded_by")
    ).distinct()
    rows = catalog.update_fields(catalogue(spark, folder), changes, ["status", "superseded_by"], F.lit(_NOW).cast("timestamp"))
    return rows.select("document_id", "status", "superseded_by")


@register(
    "applied_supersedes",
    """
WITH d AS (SELECT doc_id, source, 'ref/' || source || '/' || (doc_id // 60) AS own, CASE WHEN doc_id % 3 = 0 THEN 'ref/' || source || '/' || (doc_id // 60 - 1 + doc_id % 2) END AS ref FROM documents),
f AS (SELECT n.doc_id AS newer, max(o.doc_id) AS old FROM d n JOIN d o ON o.source = n.source AND lower(o.own) = lower(n.ref) AND o.doc_id <> n.doc_id GROUP BY n.doc_id),
l AS (SELECT old, max(newer) AS newer FROM f GROUP BY old)
SELECT doc_id AS document_id, coalesce(newer, CASE WHEN doc_id % 11 = 0 THEN -1 END) AS superseded_by FROM documents LEFT JOIN l ON old = doc_id
""",
)
def applied_supersedes(spark, folder):
    """Successors written into the catalogue; a successor known before stays where no newer claim is found."""
    d = F.col("doc_id")
    shelf = F.floor(d / 60)
    documents = table(spark, folder, "documents").select(
        d.alias("document_id"), F.col("source").alias("department_id"), F.lit(None).cast("timestamp").alias("deleted_at"), d.alias("created_at"),
        F.concat(F.lit("ref/"), F.col("source"), F.lit("/"), shelf.cast("string")).alias("reference_no"),
        F.when(F.pmod(d, F.lit(3)) == 0, F.concat(F.lit("ref/"), F.col("source"), F.lit("/"), (shelf - 1 + F.pmod(d, F.lit(2))).cast("string"))).alias("supersedes_ref"),
        F.when(F.pmod(d, F.lit(11)) == 0, F.lit(-1).cast("bigint")).alias("superseded_by"),
    )
    return enrich.apply_supersedes(documents).select("document_id", "superseded_by")


@register(
    "readable_duplicates",
    f"""
WITH {CATALOGUE_SQL}, firsts AS (SELECT sha256(text) AS h, min(document_id) AS first FROM cat GROUP BY 1)
SELECT c.document_id, o.document_id AS original_id, o.title AS original_title, 'exact' AS tier
FROM cat c JOIN firsts f ON f.h = sha256(c.text) AND f.first < c.document_id JOIN cat o ON o.document_id = f.first
WHERE o.deleted_at IS NULL AND o.department_id IN {GROUPS_SQL}
""",
)
def readable_duplicates(spark, folder):
    """Documents with the text of an earlier one; only readable originals are named."""
    rows = catalogue(spark, folder).withColumn("_h", F.sha2(F.col("text").cast("binary"), 256))
    rows = rows.join(rows.groupBy("_h").agg(F.min("document_id").alias("_first")), "_h")
    copy = F.col("_first") < F.col("document_id")
    rows = rows.withColumns({"duplicate_of": F.when(copy, F.col("_first")), "duplicate_tier": F.when(copy, "exact")}).drop("_h", "_first")
    return catalog.duplicate_titles(rows, GROUPS).select("document_id", "original_id", "original_title", "tier")


@register(
    "document_details",
    f"""
WITH {CATALOGUE_SQL}, {DOCUMENT_TAGS_SQL}, v AS (SELECT o_custkey AS document_id, max(o_orderkey) AS version_no FROM orders GROUP BY 1),
t AS (SELECT document_id, string_agg(tag_name, '|' ORDER BY tag_name) AS tags FROM doc_tags GROUP BY document_id)
SELECT c.document_id, c.title, v.version_no, t.tags FROM cat c LEFT JOIN v USING (document_id) LEFT JOIN t USING (document_id)
""",
)
def document_details(spark, folder):
    """Catalogue rows with the current version and the tag list, each joined once."""
    versions = table(spark, folder, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderkey").alias("version_no"))
    cat = catalogue(spark, folder).select("document_id", "title")
    current = versioning.current_versions(cat.withColumn("current_version_id", F.lit(None).cast("bigint")), versions).select("document_id", "version_no")
    links = document_tags(spark, folder).select("document_id", F.col("tag_name").alias("tag_id"), F.lit("confirmed").alias("status"), F.lit("user").alias("source"), F.lit(None).cast("double").alias("similarity"))
    lists = catalog.document_tag_lists(links, links.select("tag_id", F.col("tag_id").alias("name")).distinct())
    return catalog.details(cat, current, lists).select("document_id", "title", "version_no", F.array_join(F.transform("tags", lambda t: t["name"]), "|").alias("tags"))


# --- tags --------------------------------------------------------------------

_TAGS_SQL = "tags AS (SELECT DISTINCT lang AS name, NULL AS department_id FROM documents UNION ALL SELECT DISTINCT lang || '-' || source, source FROM documents)"


def _tags(spark, folder):
    """Languages as tags of all departments, language and source as tags of one."""
    documents = table(spark, folder, "documents")
    shared = documents.select(F.col("lang").alias("name"), F.lit(None).cast("string").alias("department_id"))
    return shared.unionByName(documents.select(F.concat_ws("-", "lang", "source").alias("name"), F.col("source").alias("department_id"))).distinct()


@register("visible_tags", f"WITH {_TAGS_SQL} SELECT name, department_id FROM tags WHERE department_id IS NULL OR department_id IN {GROUPS_SQL}")
def visible_tags(spark, folder):
    return access.visible_tags(_tags(spark, folder), GROUPS)


@register(
    "new_tag_links",
    """
WITH named AS (SELECT doc_id AS document_id, 'T:' || lang AS tag_id FROM documents UNION SELECT doc_id, 'T:' || lang || '-' || source FROM documents),
close AS (SELECT d.doc_id AS document_id, 'T:' || lang AS tag_id, 0.5::DOUBLE + 0.25 * quality AS similarity FROM labels l JOIN documents d USING (doc_id)),
merged AS (SELECT document_id, tag_id, max(similarity) AS similarity FROM (SELECT *, NULL::DOUBLE AS similarity FROM named UNION ALL SELECT * FROM close) GROUP BY ALL)
SELECT document_id, tag_id, similarity, 'ai' AS source, 'suggested' AS status FROM merged WHERE NOT (document_id % 4 = 0 AND tag_id IN (SELECT 'T:' || lang FROM documents d WHERE d.doc_id = document_id))
""",
)
def new_tag_links(spark, folder):
    """Names in another case and spacing find their tag; links that exist are not suggested again."""
    documents = table(spark, folder, "documents")
    tags = _tags(spark, folder).withColumn("tag_id", F.concat(F.lit("T:"), F.col("name")))
    names = F.array(F.concat(F.lit("  "), F.upper("lang")), F.concat(F.col("lang"), F.lit("-"), F.col("source"), F.lit(" ")), F.lit("no such tag"))
    named = enrich.named_tags(documents.select(F.col("doc_id").alias("document_id"), F.col("source").alias("department_id"), names.alias("names")), tags)
    linked = documents.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("T:"), F.col("lang")).alias("tag_id"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("document_id"), (F.lit(0.5) + F.lit(0.25) * F.col("quality")).alias("similarity"))
    return enrich.new_tag_links(linked.join(labels, "document_id"), named, linked.where(F.pmod("document_id", F.lit(4)) == 0))


@register(
    "created_tags",
    """
WITH have AS (SELECT row_number() OVER (ORDER BY lang) AS tag_id, lang AS name FROM (SELECT DISTINCT lang FROM documents)),
want AS (SELECT (regexp_extract_all(text, '[\\p{L}\\p{N}]+'))[1] AS name, source AS department_id FROM documents),
fresh AS (SELECT lower(name) AS k, department_id, min(name) AS name FROM want WHERE name IS NOT NULL GROUP BY ALL)
SELECT tag_id::BIGINT AS tag_id, name, NULL AS department_id FROM have UNION ALL
SELECT (SELECT max(tag_id) FROM have) + row_number() OVER (ORDER BY k, department_id), name, department_id FROM fresh
""",
)
def created_tags(spark, folder):
    """Languages are tags already, also when asked for in another case; first words of documents become new ones of their departments, with dense ids."""
    docs = table(spark, folder, "documents")
    languages = docs.select(F.col("lang").alias("name")).distinct()  # a handful
    tags = languages.select(F.row_number().over(Window.orderBy("name")).cast("bigint").alias("tag_id"), "name", F.lit(None).cast("string").alias("department_id"))
    first = F.get(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 0)
    words = docs.select(first.alias("name"), F.col("source").alias("department_id")).where("name is not null")
    again = tags.select(F.upper("name").alias("name"), "department_id")
    return catalog.get_or_create_tags(tags, words.unionByName(again)).select("tag_id", "name", "department_id")


# --- folders -----------------------------------------------------------------


def _filed(spark, folder, column):
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("document_id"), F.concat(F.lit("s"), F.col(column).cast("string")).alias("folder_id"),
        F.when(F.col("l_linestatus") != "O", F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"),
    )


@register(
    "known_folders",
    """
SELECT l_orderkey * 10 + l_linenumber AS document_id, CASE WHEN l_partkey IN (SELECT s_suppkey FROM supplier) THEN 's' || l_partkey ELSE 'inbox' END AS folder_id FROM lineitem
""",
)
def known_folders(spark, folder):
    """Line items filed by part number; numbers that are no supplier's fall into the inbox."""
    return folders.known_folder(_filed(spark, folder, "l_partkey"), _folders(spark, folder)).select("document_id", "folder_id")


@register(
    "deleted_folder",
    f"""
WITH gone AS (SELECT 's' || s_suppkey AS folder_id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2),
docs AS (SELECT l_orderkey * 10 + l_linenumber AS document_id, 's' || l_suppkey AS folder_id, CASE WHEN l_linestatus <> 'O' THEN TIMESTAMP '2024-01-01' END AS deleted_at FROM lineitem)
SELECT document_id, CASE WHEN g.folder_id IS NULL THEN d.folder_id END AS folder_id, CASE WHEN g.folder_id IS NOT NULL THEN coalesce(deleted_at, TIMESTAMP '{_NOW}') ELSE deleted_at END AS deleted_at
FROM docs d LEFT JOIN gone g ON g.folder_id = d.folder_id
""",
)
def deleted_folder(spark, folder):
    """A region goes with all its nations and suppliers, and the documents inside."""
    return folders.delete_folder(_folders(spark, folder), _filed(spark, folder, "l_suppkey"), "r2", F.lit(_NOW).cast("timestamp"))[1]


@register("moved_folder", f"WITH {_FOLDERS_SQL} SELECT folder_id, name, CASE WHEN folder_id = 'r1' THEN 'inbox' ELSE parent_id END AS parent_id FROM folders")
def moved_folder(spark, folder):
    """A region moved below another top folder; what lies in it moves along."""
    return folders.change_folder(_folders(spark, folder), "r1", parent_id="inbox", move=True)


@register(
    "folder_listing",
    f"WITH {_FOLDERS_SQL} SELECT folder_id, name FROM folders ORDER BY CASE WHEN folder_id = 'inbox' THEN 0 ELSE 1 END, lower(name), folder_id LIMIT 30",
)
def folder_listing(spark, folder):
    """The first page of folders: the inbox first, then by name without case."""
    return _folders(spark, folder).orderBy(*folders.folder_order()).limit(30).select("folder_id", "name")


# --- model replies and titles ------------------------------------------------


@register(
    "model_replies",
    """
SELECT doc_id AS document_id, CASE WHEN doc_id % 5 <> 0 THEN 'Report no ' || doc_id END AS title, CASE WHEN doc_id % 5 <> 0 THEN 'REF/' || doc_id END AS reference_no,
  CASE WHEN doc_id % 5 <> 0 THEN '2024-03-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS effective_date FROM documents
""",
)
def model_replies(spark, folder):
    """Fenced, embedded and missing JSON in a model's reply."""
    d = F.col("doc_id").cast("string")
    day = F.lpad((F.pmod("doc_id", F.lit(28)) + 1).cast("string"), 2, "0")
    body = F.concat(F.lit('{"title": "  Report no '), d, F.lit(' ", "doctype": null, "reference_no": "REF/'), d, F.lit('", "effective_date": "2024-03-'), day, F.lit('", "tags": []}'))
    reply = (
        F.when(F.pmod("doc_id", F.lit(5)) == 0, F.lit("I can not tell {what} it is."))
        .when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
        .otherwise(F.concat(F.lit("It is "), body, F.lit(" as asked.")))
    )
    rows = with_enrichment(table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), reply.alias("reply")), "reply")
    return rows.select("document_id", "enriched.title", "enriched.reference_no", "enriched.effective_date")


@register(
    "chosen_titles",
    f"""
WITH d AS (SELECT doc_id, doc_id % 3 AS k, (doc_id % 11) / 10 AS c, CASE WHEN doc_id % 4 <> 0 THEN 'Model ' || doc_id END AS model FROM documents)
SELECT doc_id AS document_id, CASE WHEN k = 0 THEN NULL WHEN c < {DEFAULTS.title_llm_threshold} AND model IS NOT NULL THEN model ELSE 'Own ' || doc_id END AS title,
  CASE WHEN k = 0 THEN NULL WHEN c < {DEFAULTS.title_llm_threshold} AND model IS NOT NULL THEN 'llm' ELSE 'heading' END AS title_source FROM d
""",
)
def chosen_titles(spark, folder):
    """A user's title stays; a weak heuristic yields to the model's title where there is one."""
    d = F.col("doc_id")
    number = d.cast("string")
    own = F.struct(F.concat(F.lit("Own "), number).alias("title"), F.lit("heading").alias("source"), (F.pmod(d, F.lit(11)) / 10).alias("confidence"))
    source = F.when(F.pmod(d, F.lit(3)) == 0, "user").otherwise("default")
    model = F.when(F.pmod(d, F.lit(4)) != 0, F.concat(F.lit("Model "), number))
    rows = table(spark, folder, "documents").select(d.alias("document_id"), own.alias("own"), source.alias("source"), model.alias("model"))
    picked = rows.withColumn("t", choose_title(F.col("source"), F.col("own"), F.col("model")))
    return picked.select("document_id", F.col("t.title").alias("title"), F.col("t.source").alias("title_source"))


@register(
    "versioned_documents",
    """
SELECT d.doc_id, d.source, CASE WHEN l.quality = 0 THEN 0 ELSE d.n_chars END AS n_chars
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0
""",
)
def versioned_documents(spark, folder):
    """The newest generation of a stored table after poor documents were replaced and toxic ones taken out."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "source", "n_chars"), table(spark, folder, "labels")
    stored = Versioned(spark, f"{shared_folder(spark)}/documents")
    stored.create(docs, ["doc_id"])
    poor = docs.join(labels.where("quality = 0"), "doc_id", "left_semi").withColumn("n_chars", F.lit(0).cast("bigint"))
    stored.change(poor)
    stored.change(gone=labels.where("toxic = 1").select("doc_id"))
    return stored.read()


@register(
    "changed_tag_centroids",
    """
WITH links AS (
  SELECT label AS tag_id, vec_id FROM embeddings WHERE vec_id % 5 <> 0
  UNION SELECT (label + 1) % 10, vec_id FROM embeddings WHERE vec_id % 3 = 0),
parts AS (SELECT tag_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM links JOIN embeddings USING (vec_id)),
sums AS (SELECT tag_id, i, sum(x) AS s FROM parts GROUP BY ALL),
norms AS (SELECT tag_id, sqrt(sum(s * s)) AS n FROM sums GROUP BY tag_id)
SELECT tag_id, CAST(i - 1 AS INTEGER) AS pos, round(s / n, 6) AS value FROM sums JOIN norms USING (tag_id)
""",
)
def changed_tag_centroids(spark, folder):
    """Every label is a confirmed tag; each fifth link is removed, and each third vector gets the next tag too."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("document_id"), "label", F.col("embedding").alias("vector"))
    vectors = rows.select("document_id", "vector")
    links = rows.select("document_id", F.col("label").alias("tag_id"), F.lit("user").alias("source"), F.lit("confirmed").alias("status"))
    state = cut_lineage(centroids.advanced(None, links.select("tag_id", "document_id", F.lit(1).alias("step")), vectors))
    removed = rows.where("document_id % 5 = 0").select("document_id", F.col("label").alias("tag_id"), F.lit("remove").alias("action"), F.lit(1).alias("at"))
    added = rows.where("document_id % 3 = 0").select("document_id", ((F.col("label") + 1) % 10).alias("tag_id"), F.lit("confirm").alias("action"), F.lit(2).alias("at"))
    _, steps = centroids.apply_changes(links, removed.unionByName(added))
    found = centroids.centroids(centroids.advanced(state, steps, vectors))
    return found.select("tag_id", F.posexplode("centroid").alias("pos", "value")).select("tag_id", "pos", F.round("value", 6).alias("value"))
