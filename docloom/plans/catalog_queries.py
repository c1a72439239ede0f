"""Registered queries: listings, lookups, folders, versions, trees, jobs, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.merkle import merkle_root
from docloom.functions.skew import running_number
from docloom.functions.vectors import hash_embedder
from docloom.operators import access, catalog, chunking, conversation, enrich, folders, jobs, tree, versioning
from docloom.plans import sqltext
from docloom.plans.corpus import CATALOGUE_SQL, DOCUMENT_TAGS_SQL, GROUPS, GROUPS_SQL, VECTOR_DIM, catalogue, document_tags
from docloom.plans.registry import register
from docloom.settings import Settings
from docloom.sources.markdown import markdown_blocks
from docloom.sources.tables import spread, table

# --- catalogue ---------------------------------------------------------------


@register(
    "list_documents_page",
    f"""
WITH {CATALOGUE_SQL}, {DOCUMENT_TAGS_SQL}
SELECT document_id, title, doctype, status, department_id FROM cat
WHERE deleted_at IS NULL AND department_id IN {GROUPS_SQL} AND status = 'READY' AND document_id IN (SELECT document_id FROM doc_tags WHERE lower(tag_name) = 'good')
ORDER BY lower(title), document_id LIMIT 20 OFFSET 20
""",
)
def list_documents_page(spark, folder):
    """Second page of the ready documents tagged ``good`` by title."""
    rows = catalog.listing(catalogue(spark, folder), document_tags(spark, folder), GROUPS, tag="GOOD", status="READY")
    return catalog.page_of(rows, "title", 2, 20).select("document_id", "title", "doctype", "status", "department_id")


@register(
    "list_orders_page",
    """
SELECT o_orderkey AS document_id, o_orderdate AS created_at, c_name AS title FROM orders JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment = 'BUILDING' AND o_orderstatus <> 'P' ORDER BY created_at DESC, document_id DESC LIMIT 50 OFFSET 100
""",
)
def list_orders_page(spark, folder):
    """The same listing at volume: orders as documents, market segments as departments."""
    buyers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("department_id"))
    orders = table(spark, folder, "orders").where("o_orderstatus <> 'P'").join(buyers, "o_custkey")
    rows = orders.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at"), "title", "department_id", F.lit(None).cast("timestamp").alias("deleted_at"))
    return catalog.page_of(catalog.listing(rows, None, ["BUILDING"]), "-created_at", 3, 50).select("document_id", "created_at", "title")


@register(
    "listing_totals",
    f"WITH {CATALOGUE_SQL} SELECT department_id, doctype, count(*) AS total FROM cat WHERE deleted_at IS NULL AND department_id IN {GROUPS_SQL} GROUP BY ALL",
)
def listing_totals(spark, folder):
    rows = catalog.listing(catalogue(spark, folder), None, GROUPS)
    return rows.groupBy("department_id", "doctype").agg(F.count(F.lit(1)).alias("total"))


@register(
    "writable_documents",
    f"""
WITH {CATALOGUE_SQL}, m AS (SELECT DISTINCT source AS department_id, (['viewer','contributor','admin'])[CAST(substr(source, 4) AS INTEGER) % 3 + 1] AS role FROM documents)
SELECT document_id, department_id FROM cat JOIN m USING (department_id) WHERE deleted_at IS NULL AND role IN ('contributor', 'admin')
""",
)
def writable_documents(spark, folder):
    number = F.substring("source", 4, 9).cast("int")
    roles = F.array(F.lit("viewer"), F.lit("contributor"), F.lit("admin"))
    members = table(spark, folder, "documents").select(
        F.lit("u1").alias("user_id"), F.col("source").alias("department_id"), F.element_at(roles, F.pmod(number, F.lit(3)) + 1).alias("role")
    ).distinct()
    return access.writable(catalogue(spark, folder), members, "u1").select("document_id", "department_id")


@register(
    "user_departments",
    """
SELECT c_custkey AS user_id, c_name AS username, string_agg('d' || m.d || ':' || n_name || ':' || CASE WHEN m.d % 2 = 0 THEN 'viewer' ELSE 'admin' END, '|' ORDER BY 'd' || m.d) AS departments
FROM customer c, LATERAL (SELECT DISTINCT unnest([c_nationkey, (c_nationkey * 7 + 3) % 25]) AS d) m JOIN nation ON n_nationkey = m.d GROUP BY ALL
""",
)
def user_departments(spark, folder):
    """Customers as users, nations as departments; everyone belongs to one or two."""
    customers = table(spark, folder, "customer")
    users = customers.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    both = F.array_distinct(F.array("c_nationkey", F.pmod(F.col("c_nationkey") * 7 + 3, F.lit(25))))
    members = customers.select(F.col("c_custkey").alias("user_id"), F.explode(both).alias("d")).select(
        "user_id", F.concat(F.lit("d"), F.col("d").cast("string")).alias("department_id"), F.when(F.pmod("d", F.lit(2)) == 0, "viewer").otherwise("admin").alias("role")
    )
    departments = table(spark, folder, "nation").select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("department_id"), F.col("n_name").alias("department_name"))
    made = access.user_departments(users, members, departments)
    shown = F.array_join(F.transform("departments", lambda d: F.concat_ws(":", d["department_id"], d["department_name"], d["role"])), "|")
    return made.select("user_id", "username", shown.alias("departments"))


@register(
    "multi_get_ordered",
    """
WITH w AS (SELECT l_orderkey AS document_id, min(l_partkey * 1000000 + l_orderkey * 10 + l_linenumber) AS position FROM lineitem GROUP BY 1)
SELECT o_orderkey AS document_id, position, o_totalprice FROM w JOIN orders ON o_orderkey = document_id WHERE o_orderstatus <> 'P'
""",
)
def multi_get_ordered(spark, folder):
    """Orders fetched in the order their key is first asked for; cancelled ones are skipped."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("document_id"), "o_totalprice", F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("deleted_at")
    )
    wanted = table(spark, folder, "lineitem").select((F.col("l_partkey") * 1000000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.col("l_orderkey").alias("document_id"))
    return catalog.ordered_lookup(orders, wanted).select("document_id", "position", "o_totalprice")


@register(
    "tag_counts",
    f"""
WITH {DOCUMENT_TAGS_SQL}, t AS (SELECT row_number() OVER (ORDER BY n) AS tag_id, n AS name FROM (SELECT DISTINCT tag_name AS n FROM doc_tags UNION SELECT 'unused'))
SELECT t.name, count(d.document_id) AS doc_count FROM t LEFT JOIN doc_tags d ON d.tag_name = t.name GROUP BY t.name
""",
)
def tag_counts(spark, folder):
    links = document_tags(spark, folder).withColumnRenamed("tag_name", "tag_id")
    tags = links.select("tag_id").distinct().union(spark.range(1).select(F.lit("unused").alias("tag_id")))
    return catalog.tag_counts(tags, links).select(F.col("tag_id").alias("name"), "doc_count")


@register(
    "document_tag_lists",
    f"WITH {DOCUMENT_TAGS_SQL} SELECT document_id, string_agg(tag_name, '|' ORDER BY tag_name) AS tags FROM doc_tags GROUP BY document_id",
)
def document_tag_lists(spark, folder):
    links = document_tags(spark, folder).select("document_id", F.col("tag_name").alias("tag_id"), F.lit("confirmed").alias("status"), F.lit("user").alias("source"), F.lit(None).cast("double").alias("similarity"))
    tags = links.select("tag_id", F.col("tag_id").alias("name")).distinct()
    lists = catalog.document_tag_lists(links, tags)
    return lists.select("document_id", F.array_join(F.transform("tags", lambda t: t["name"]), "|").alias("tags"))


@register(
    "upsert_chunks",
    """
WITH old AS (SELECT p_partkey AS chunk_id, p_name AS text, p_retailprice AS embedding FROM part WHERE p_size <= 30),
new AS (SELECT p_partkey AS chunk_id, upper(p_name) AS text, CASE WHEN p_size % 2 = 0 THEN p_retailprice + 1 END AS embedding FROM part WHERE p_size >= 20)
SELECT coalesce(n.chunk_id, o.chunk_id) AS chunk_id, CASE WHEN n.chunk_id IS NOT NULL THEN n.text ELSE o.text END AS text, coalesce(n.embedding, o.embedding) AS embedding
FROM old o FULL JOIN new n ON o.chunk_id = n.chunk_id
""",
)
def upsert_chunks(spark, folder):
    """Stored rows overwritten by incoming ones; a missing vector keeps the stored vector."""
    part = table(spark, folder, "part")
    old = part.where("p_size <= 30").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text"), F.col("p_retailprice").alias("embedding"))
    new = part.where("p_size >= 20").select(
        F.col("p_partkey").alias("chunk_id"), F.upper("p_name").alias("text"), F.when(F.pmod("p_size", F.lit(2)) == 0, F.col("p_retailprice") + 1).alias("embedding")
    )
    return catalog.upsert(old, new, ["chunk_id"], ("embedding",))



@register(
    "supersedes_links",
    """
WITH d AS (SELECT doc_id, source, 'REF/' || upper(source) || '/' || (doc_id // 60) AS reference_no, CASE WHEN doc_id % 3 = 0 THEN 'ref/' || source || '/' || (doc_id // 60 - 1 + doc_id % 2) END AS ref FROM documents),
f AS (
  SELECT n.doc_id AS newer, max(o.doc_id) AS superseded_id FROM d n JOIN d o ON o.source = n.source AND lower(o.reference_no) = lower(n.ref) AND o.doc_id <> n.doc_id GROUP BY n.doc_id)
SELECT superseded_id, max(newer) AS newer_id FROM f GROUP BY superseded_id
""",
)
def supersedes_links(spark, folder):
    """Reference numbers shared by a few documents of a source; every third document replaces one."""
    d = F.col("doc_id")
    shelf = F.floor(d / 60)
    documents = table(spark, folder, "documents").select(
        d.alias("document_id"), F.col("source").alias("department_id"), F.lit(None).cast("timestamp").alias("deleted_at"), d.alias("created_at"),
        F.concat(F.lit("REF/"), F.upper("source"), F.lit("/"), shelf.cast("string")).alias("reference_no"),
        F.when(F.pmod(d, F.lit(3)) == 0, F.concat(F.lit("ref/"), F.col("source"), F.lit("/"), (shelf - 1 + F.pmod(d, F.lit(2))).cast("string"))).alias("supersedes_ref"),
    )
    return enrich.supersedes_links(documents)


# --- folders -----------------------------------------------------------------

_FOLDERS_SQL = """
folders AS (
  SELECT 'world' AS folder_id, 'World' AS name, NULL AS parent_id UNION ALL SELECT 'inbox', 'Inbox', NULL
  UNION ALL SELECT 'r' || r_regionkey, r_name, 'world' FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey FROM supplier)
"""


def _folders(spark, folder):
    top = spark.createDataFrame([("world", "World", None), ("inbox", "Inbox", None)], "folder_id string, name string, parent_id string")

    def level(name, key, label, parent):
        return table(spark, folder, name).select(key.alias("folder_id"), F.col(label).alias("name"), parent.alias("parent_id"))

    def tag(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    regions = level("region", tag("r", "r_regionkey"), "r_name", F.lit("world"))
    nations = level("nation", tag("n", "n_nationkey"), "n_name", tag("r", "n_regionkey"))
    suppliers = level("supplier", tag("s", "s_suppkey"), "s_name", tag("n", "s_nationkey"))
    return top.unionByName(regions).unionByName(nations).unionByName(suppliers)


@register(
    "folder_descendants",
    f"""
WITH RECURSIVE {_FOLDERS_SQL},
tree AS (SELECT folder_id, 1 AS depth FROM folders WHERE parent_id = 'world' UNION ALL SELECT f.folder_id, t.depth + 1 FROM folders f JOIN tree t ON f.parent_id = t.folder_id)
SELECT folder_id, depth FROM tree
""",
)
def folder_descendants(spark, folder):
    return folders.descendants(_folders(spark, folder), "world")


@register(
    "folder_paths",
    f"""
WITH RECURSIVE {_FOLDERS_SQL},
tree AS (SELECT folder_id, name AS path FROM folders WHERE parent_id IS NULL UNION ALL SELECT f.folder_id, t.path || ' / ' || f.name FROM folders f JOIN tree t ON f.parent_id = t.folder_id)
SELECT folder_id, path FROM tree
""",
)
def folder_paths(spark, folder):
    return folders.paths(_folders(spark, folder)).select("folder_id", F.array_join("path", " / ").alias("path"))


@register(
    "folder_counts",
    f"""
WITH {_FOLDERS_SQL}
SELECT f.folder_id, f.name, count(l.l_orderkey) AS doc_count FROM folders f
LEFT JOIN lineitem l ON f.folder_id = 's' || l.l_suppkey AND l.l_returnflag IN ('A', 'N') AND l.l_linestatus = 'O' GROUP BY ALL
""",
)
def folder_counts(spark, folder):
    """Line items filed under suppliers; return flags stand for departments."""
    rows = table(spark, folder, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("folder_id"), F.col("l_returnflag").alias("department_id"),
        F.when(F.col("l_linestatus") != "O", F.col("l_shipdate")).alias("deleted_at"),
    )
    return folders.with_counts(_folders(spark, folder), rows, ["A", "N"]).select("folder_id", "name", "doc_count")


# --- versions ----------------------------------------------------------------

_MANIFEST_SQL = f"""
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '') AS l FROM documents),
m AS (
  SELECT doc_id, list_transform(l, lambda x: md5(x)) AS old,
    list_transform(list_filter(l, lambda x, i: i = 1 OR (i + doc_id) % 7 <> 0), lambda x, i: md5(CASE WHEN (i + doc_id) % 5 = 0 THEN x || ' (amended)' ELSE x END)) AS new FROM lines)
"""


def _manifests(spark, folder):
    """Two versions of each document: some lines dropped, some amended."""
    lines = F.filter(F.split("text", "\n"), lambda l: F.trim(l) != "")
    d = F.col("doc_id")
    kept = F.filter(lines, lambda l, i: (i == 0) | (F.pmod(i + 1 + d, F.lit(7)) != 0))
    amended = F.transform(kept, lambda l, i: F.md5(F.when(F.pmod(i + 1 + d, F.lit(5)) == 0, F.concat(l, F.lit(" (amended)"))).otherwise(l).cast("binary")))
    return table(spark, folder, "documents").select(
        "doc_id", F.transform(lines, lambda l: F.md5(l.cast("binary"))).alias("old_manifest"), amended.alias("new_manifest")
    )


@register(
    "version_diff",
    f"""
WITH {_MANIFEST_SQL}
SELECT doc_id, array_to_string(list_filter(new, lambda c: NOT list_contains(old, c)), ',') AS added, array_to_string(list_filter(old, lambda c: NOT list_contains(new, c)), ',') AS removed,
  array_to_string(list_filter(new, lambda c: list_contains(old, c)), ',') AS reused, old = new AS unchanged FROM m
""",
)
def version_diff(spark, folder):
    planned = versioning.plan_delta(_manifests(spark, folder))
    join = lambda c: F.array_join(c, ",").alias(c)
    return planned.select("doc_id", join("added"), join("removed"), join("reused"), "unchanged")


@register(
    "delta_stats",
    f"""
WITH {_MANIFEST_SQL}
SELECT doc_id AS document_id, len(list_filter(new, lambda c: NOT list_contains(old, c))) AS added, len(list_filter(old, lambda c: NOT list_contains(new, c))) AS removed,
  len(list_filter(new, lambda c: list_contains(old, c))) AS reused,
  CASE WHEN len(new) > 0 THEN len(list_filter(new, lambda c: NOT list_contains(old, c))) / len(new) > 0.2 ELSE false END AS reenrich FROM m WHERE len(old) > 0
""",
)
def delta_stats(spark, folder):
    """Counts from exploded manifests, joined on (document, chunk)."""
    both = _manifests(spark, folder)
    old = both.select(F.col("doc_id").alias("document_id"), F.explode("old_manifest").alias("chunk_id"))
    new = both.select(F.col("doc_id").alias("document_id"), F.explode("new_manifest").alias("chunk_id"))
    counted = versioning.delta_statistics(versioning.diff_rows(old, new))
    return counted.withColumn("reenrich", versioning.needs_enrichment(F.col("added"), F.col("added") + F.col("reused")))


@register(
    "merkle_roots",
    f"""
WITH RECURSIVE {_MANIFEST_SQL},
leaves AS (SELECT doc_id, unnest(old) AS id, generate_subscripts(old, 1) - 1 AS i, len(old) AS n FROM m),
tree AS (
  SELECT doc_id, i, n, unhex(sha256(id)) AS h FROM leaves
  UNION ALL
  SELECT doc_id, i // 2, (n + 1) // 2, CASE WHEN nxt IS NULL THEN h ELSE unhex(sha256(h || nxt)) END
  FROM (SELECT *, lead(h) OVER (PARTITION BY doc_id, n ORDER BY i) AS nxt FROM tree WHERE n > 1) WHERE i % 2 = 0)
SELECT m.doc_id, coalesce(lower(hex(h)), sha256('')) AS merkle_root FROM m LEFT JOIN tree t ON t.doc_id = m.doc_id AND t.n = 1
""",
)
def merkle_roots(spark, folder):
    return _manifests(spark, folder).select("doc_id", merkle_root(F.col("old_manifest")).alias("merkle_root"))


@register(
    "previous_version",
    """
WITH v AS (SELECT o_custkey AS document_id, o_orderkey AS version_no, o_totalprice AS size_bytes FROM orders)
SELECT document_id, version_no, lag(version_no) OVER w AS prev_version_no, lag(size_bytes) OVER w AS prev_size_bytes FROM v WINDOW w AS (PARTITION BY document_id ORDER BY version_no)
""",
)
def previous_version(spark, folder):
    """Orders as versions of their customer, numbered by order key."""
    versions = table(spark, folder, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_no"), F.col("o_totalprice").alias("size_bytes"))
    return versioning.previous_versions(versions, values=["size_bytes"]).select("document_id", "version_no", "prev_version_no", "prev_size_bytes")


@register(
    "current_version",
    """
WITH v AS (SELECT o_custkey AS document_id, o_orderkey AS version_no, o_totalprice AS size_bytes FROM orders),
p AS (SELECT c_custkey AS document_id, CASE WHEN c_custkey % 4 = 0 THEN (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) END AS pointer FROM customer)
SELECT p.document_id, coalesce(a.version_no, b.version_no) AS version_no, coalesce(a.size_bytes, b.size_bytes) AS size_bytes
FROM p LEFT JOIN v a ON a.document_id = p.document_id AND a.version_no = p.pointer
LEFT JOIN (SELECT document_id, max(version_no) AS version_no, arg_max(size_bytes, version_no) AS size_bytes FROM v GROUP BY 1) b ON b.document_id = p.document_id
WHERE coalesce(a.version_no, b.version_no) IS NOT NULL
""",
)
def current_version(spark, folder):
    """A quarter of the documents point at their first version; the others fall back to the highest."""
    orders = table(spark, folder, "orders")
    versions = orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderkey").alias("version_no"), F.col("o_totalprice").alias("size_bytes"))
    first = orders.groupBy(F.col("o_custkey").alias("document_id")).agg(F.min("o_orderkey").alias("first"))
    documents = table(spark, folder, "customer").select(F.col("c_custkey").alias("document_id")).join(first, "document_id", "left")
    documents = documents.select("document_id", F.when(F.pmod("document_id", F.lit(4)) == 0, F.col("first")).alias("current_version_id"))
    return versioning.current_versions(documents, versions).select("document_id", "version_no", "size_bytes")


@register(
    "version_numbers",
    "SELECT o_orderkey, o_custkey AS document_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version_no FROM orders",
)
def version_numbers(spark, folder):
    uploads = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("document_id"), "o_orderdate")
    block = F.date_trunc("year", "o_orderdate")
    numbered = running_number(uploads, ["document_id"], block, [F.col("o_orderdate"), F.col("o_orderkey")], "version_no")
    return numbered.select("o_orderkey", "document_id", "version_no")


@register(
    "dirty_ancestors",
    """
WITH RECURSIVE edges AS (
  SELECT DISTINCT l_orderkey AS document_id, 'line' || l_linenumber AS child, 'half' || (l_linenumber % 2) AS parent FROM lineitem
  UNION SELECT DISTINCT l_orderkey, 'half' || (l_linenumber % 2), 'root' FROM lineitem),
dirty AS (
  SELECT DISTINCT e.document_id, e.parent FROM edges e JOIN (SELECT l_orderkey, 'line' || l_linenumber AS child FROM lineitem WHERE l_returnflag = 'R') c ON c.l_orderkey = e.document_id AND c.child = e.child
  UNION SELECT e.document_id, e.parent FROM edges e JOIN dirty d ON d.document_id = e.document_id AND d.parent = e.child)
SELECT document_id, parent AS node_id FROM dirty
""",
)
def dirty_ancestors(spark, folder):
    """Orders as documents, lines as chunks under two halves and a root; returned lines changed."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber", "l_returnflag")
    chunk = F.concat(F.lit("line"), F.col("l_linenumber").cast("string"))
    half = F.concat(F.lit("half"), F.pmod("l_linenumber", F.lit(2)).cast("string"))
    halves = lines.groupBy("document_id", half.alias("node_id")).agg(F.collect_set(chunk).alias("children"))
    top = halves.groupBy("document_id").agg(F.collect_set("node_id").alias("children")).select("document_id", F.lit("root").alias("node_id"), "children")
    changed = lines.where("l_returnflag = 'R'").select("document_id", chunk.alias("chunk_id"))
    return versioning.dirty_nodes(halves.unionByName(top), changed)


# --- jobs --------------------------------------------------------------------

_JOBS_SQL = """
jobs AS (
  SELECT event_id AS job_id, user_id AS document_id, (['extract','index','enrich','summarize','delta'])[event_id % 5 + 1] AS stage,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'queued' ELSE 'done' END AS status, ts FROM events)
"""


def _jobs(spark, folder):
    stages = F.array(*[F.lit(s) for s in jobs.STAGES])
    return table(spark, folder, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("document_id"), F.element_at(stages, (F.pmod("event_id", F.lit(5)) + 1).cast("int")).alias("stage"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "queued").otherwise("done").alias("status"),
        F.col("ts").alias("updated_at"), F.col("ts").alias("run_after"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"),
    )


@register(
    "latest_job_per_stage",
    f"""
WITH {_JOBS_SQL}
SELECT document_id, stage, CAST(list_position(['extract','index','enrich','summarize','delta'], stage) AS INTEGER) AS stage_order, max(job_id) AS job_id, arg_max(status, job_id) AS status FROM jobs GROUP BY document_id, stage
""",
)
def latest_job_per_stage(spark, folder):
    return jobs.latest_per_stage(_jobs(spark, folder)).select("document_id", "stage", "stage_order", "job_id", "status")


@register(
    "document_status",
    f"""
WITH {_JOBS_SQL}, l AS (SELECT document_id, stage, max(job_id) AS job_id, arg_max(status, job_id) AS status FROM jobs GROUP BY document_id, stage),
f AS (SELECT document_id, arg_max(stage, job_id) FILTER (WHERE status = 'failed') AS failed_stage, arg_max(stage, job_id) FILTER (WHERE status = 'done') AS done_stage FROM l GROUP BY document_id)
SELECT document_id, failed_stage, CASE WHEN failed_stage IS NOT NULL THEN 'FAILED' ELSE CASE done_stage WHEN 'extract' THEN 'EXTRACTED' WHEN 'index' THEN 'INDEXED'
  WHEN 'enrich' THEN 'ENRICHED' WHEN 'summarize' THEN 'READY' WHEN 'delta' THEN 'READY' ELSE 'UPLOADED' END END AS status FROM f
""",
)
def document_status(spark, folder):
    return jobs.document_status(jobs.latest_per_stage(_jobs(spark, folder))).select("document_id", "failed_stage", "status")


@register(
    "job_backoff",
    f"""
WITH {_JOBS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY document_id, stage ORDER BY ts, job_id) AS attempt FROM jobs WHERE status = 'failed')
SELECT job_id, document_id, stage, CAST(attempt AS INTEGER) AS attempt, CASE WHEN attempt < 3 THEN 'queued' ELSE 'failed' END AS status,
  CASE WHEN attempt < 3 THEN ts + to_seconds(CAST(pow(2, attempt) AS INTEGER)) END AS retry_at FROM n
""",
)
def job_backoff(spark, folder):
    failures = _jobs(spark, folder).where("status = 'failed'")
    scheduled = jobs.retry_schedule(failures, "updated_at", F.date_trunc("day", "updated_at"))
    return scheduled.select("job_id", "document_id", "stage", "attempt", "status", "retry_at")


@register(
    "claim_jobs",
    f"""
WITH {_JOBS_SQL}
SELECT job_id, document_id, stage, 'running' AS status, 1 AS attempts FROM jobs WHERE status = 'queued' AND ts <= TIMESTAMP '2024-01-20' AND stage IN ('extract', 'delta') ORDER BY job_id LIMIT 100
""",
)
def claim_jobs(spark, folder):
    taken = jobs.claim(_jobs(spark, folder), F.lit("2024-01-20").cast("timestamp"), 100, ["extract", "delta"])
    return taken.select("job_id", "document_id", "stage", "status", "attempts")


# --- conversations and text structure ----------------------------------------

_RECENT_SQL = f"""
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE {sqltext.strip('text')} <> '') WHERE n <= 12)
"""


@register("last_turns", f"WITH {_RECENT_SQL} SELECT conv_id, turn, role FROM recent")
def last_turns(spark, folder):
    return conversation.last_turns(table(spark, folder, "conversations")).select("conv_id", "turn", "role")


@register(
    "conversation_history",
    f"""
WITH {_RECENT_SQL},
c AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS chg FROM recent),
r AS (SELECT *, sum(chg) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c),
g AS (SELECT conv_id, run, min(role) AS role, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_hash FROM r GROUP BY conv_id, run),
b AS (SELECT conv_id, min(run) FILTER (WHERE role = 'user') AS lo, max(run) FILTER (WHERE role = 'assistant') AS hi FROM g GROUP BY conv_id)
SELECT g.conv_id, CAST(run - lo + 1 AS INTEGER) AS position, role, text_hash FROM g JOIN b ON b.conv_id = g.conv_id WHERE run BETWEEN lo AND hi
""",
)
def conversation_history(spark, folder):
    made = conversation.history(table(spark, folder, "conversations"))
    return made.select("conv_id", "position", "role", F.md5(F.col("text").cast("binary")).alias("text_hash"))


_MARKUP = "regexp_replace(regexp_replace(text, '([.!?]) ', '\\1' || chr(10), 'g'), '(^|\\n)The ', '\\1## The ', 'g')"


@register(
    "markdown_blocks",
    rf"""
WITH pages AS (SELECT doc_id, {_MARKUP} AS t FROM documents),
lines AS (SELECT doc_id, {sqltext.strip('unnest(l)')} AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM pages)),
kinds AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN starts_with(line, '|') AND ends_with(line, '|') AND length(line) > 1 THEN 'table'
  WHEN regexp_matches(line, '^#{{1,6}}') THEN 'heading' ELSE 'paragraph' END AS kind FROM lines),
marks AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) OR kind IN ('heading', 'blank') THEN 1 ELSE 0 END AS brk FROM kinds),
isl AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM marks),
body AS (SELECT doc_id, island, pos, kind, CASE WHEN kind = 'heading' THEN length(regexp_extract(line, '^(#{{1,6}})', 1)) END AS level,
  CASE WHEN kind = 'heading' THEN {sqltext.strip("regexp_replace(" + sqltext.strip("regexp_replace(line, '^#{1,6}', '')") + ", '#+$', '')")}
    WHEN kind = 'table' THEN array_to_string(list_transform(string_split(regexp_replace(line, '^\|+|\|+$', '', 'g'), '|'), lambda c: {sqltext.strip('c')}), ' | ') ELSE line END AS b FROM isl WHERE kind <> 'blank'),
blocks AS (SELECT doc_id, island, min(kind) AS type, CAST(min(level) AS INTEGER) AS level, string_agg(b, chr(10) ORDER BY pos) AS text FROM body GROUP BY doc_id, island)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS INTEGER) AS "order", type, level, md5(text) AS text_hash FROM blocks WHERE {sqltext.strip('text')} <> ''
""",
)
def markdown(spark, folder):
    """Document texts as pages: one sentence per line, sentences starting with ``The`` made headings."""
    marked = F.regexp_replace(F.regexp_replace("text", "([.!?]) ", "$1\n"), r"(^|\n)The ", "$1## The ")
    pages = spread(table(spark, folder, "documents")).select("doc_id", marked.alias("text"))
    return markdown_blocks(pages, ["doc_id"], "text").select("doc_id", "order", "type", "level", F.md5(F.col("text").cast("binary")).alias("text_hash"))


def chunks(spark, folder, settings: Settings = Settings()):
    documents = spread(table(spark, folder, "documents")).select(F.col("doc_id").alias("document_id"), chunking.line_blocks(F.col("text")).alias("blocks"))
    return chunking.chunk_documents(documents, settings=settings)


@register("chunk_documents")
def chunk_documents(spark, folder):
    """Checked by tests against a direct implementation: the packing fold has no SQL form."""
    return chunks(spark, folder).select("document_id", "chunk_id", "ord", "page_from", "page_to", "token_count", "text")


@register("summary_tree")
def summary_tree(spark, folder):
    """Trees over small chunks, so that many documents get several levels. Checked by tests."""
    small = Settings(chunk_target_tokens=60, chunk_max_tokens=80, embed_dim=VECTOR_DIM)
    made = chunks(spark, folder, small).withColumn("embedding", hash_embedder(VECTOR_DIM)("text"))
    nodes = tree.build_tree(made, settings=small)
    return nodes.select("document_id", "node_id", "level", F.size("children").alias("n_children"), "summary_text")
