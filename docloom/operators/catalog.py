"""The document catalogue: lookups, listings, counts and row changes expressed as new DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.skew import attach_per_key, running_number, top_per_key
from docloom.functions.text import collapse
from docloom.operators.access import live, readable

# What listings may sort by and which fields may be changed.
SORT_KEYS = {"created_at": "created_at", "updated_at": "updated_at", "title": "lower(title)", "status": "status"}
UPDATABLE = {
    "title", "title_source", "title_confidence", "doctype", "meta", "superseded_by", "duplicate_of", "duplicate_tier", "root_summary",
    "signature", "status", "status_detail", "current_version_id", "folder_id", "deleted_at",
}


def sort_order(sort: str, tiebreak: str = "document_id") -> list[Column]:
    """``title``, ``-created_at``, ...; anything unknown means newest first. The tiebreak follows the direction."""
    name = sort.lstrip("-+")
    descending = sort.startswith("-") or name not in SORT_KEYS
    columns = [F.expr(SORT_KEYS.get(name, "created_at")), F.col(tiebreak)]
    return [c.desc() if descending else c.asc() for c in columns]


def listing(
    documents: DataFrame,
    document_tags: DataFrame | None,
    departments: list[str],
    doctype: str | None = None,
    tag: str | None = None,
    status: str | None = None,
    folders: list[str] | None = None,
) -> DataFrame:
    """Live documents passing every given filter (unsorted)."""
    rows = readable(documents, departments)
    if folders is not None:
        rows = rows.where(F.col("folder_id").isin(folders))
    if doctype:
        rows = rows.where(F.col("doctype") == doctype)
    if status:
        rows = rows.where(F.col("status") == status)
    if tag:
        tagged = document_tags.where(F.lower("tag_name") == tag.lower()).select("document_id")
        rows = rows.join(tagged, "document_id", "left_semi")
    return rows


def page_of(rows: DataFrame, sort: str = "-created_at", page: int = 1, page_size: int = 20) -> DataFrame:
    page, page_size = max(1, page), max(1, page_size)
    return rows.orderBy(*sort_order(sort)).offset((page - 1) * page_size).limit(page_size)


def ordered_lookup(documents: DataFrame, wanted: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of the requested keys in order of first request; missing keys are skipped.

    ``wanted`` is ``(position, key)``; repeats keep their first position.
    """
    first = wanted.groupBy(key).agg(F.min("position").alias("position"))
    return live(documents).join(first, key)


def find_by_reference(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """Newest live document with a reference number, never the requesting one.

    ``requests`` is ``(document_id, department_id, reference_no)``. Two candidates per reference are
    enough: the newest, and the next one in case the newest is the requester itself.
    """
    keyed = live(documents).where(F.col("reference_no").isNotNull()).select(
        "department_id", F.lower("reference_no").alias("ref"), F.col("document_id").alias("found"), "created_at"
    )
    newest = top_per_key(keyed, ["department_id", "ref"], [F.col("created_at").desc(), F.col("found").desc()], 2, "_n")
    per_reference = newest.groupBy("department_id", "ref").agg(
        F.max(F.when(F.col("_n") == 1, F.col("found"))).alias("_first"), F.max(F.when(F.col("_n") == 2, F.col("found"))).alias("_second")
    )
    asked = requests.select("document_id", "department_id", F.lower("reference_no").alias("ref")).where(F.col("ref").isNotNull())
    sizes = asked.groupBy("department_id", "ref").agg(F.count(F.lit(1)).alias("_asked"))
    facts = sizes.join(per_reference, ["department_id", "ref"], "left")
    joined = attach_per_key(asked, facts, ["department_id", "ref"], "_asked", "document_id")
    target = F.when(F.col("_first") == F.col("document_id"), F.col("_second")).otherwise(F.col("_first"))
    return joined.withColumn("found_id", target).where(F.col("found_id").isNotNull()).select("document_id", "department_id", "found_id")


def version_by_hash(versions: DataFrame, documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """Earliest live version of each content hash."""
    alive = versions.join(live(documents).select("document_id"), "document_id", "left_semi")
    wanted = alive.join(hashes.select("sha256").distinct(), "sha256", "left_semi")
    return top_per_key(wanted, ["sha256"], [F.col("created_at"), F.col("version_no"), F.col("document_id")], 1, "_n").drop("_n")


def tag_counts(tags: DataFrame, document_tags: DataFrame) -> DataFrame:
    """Every tag with its number of links, deleted documents included."""
    counts = document_tags.groupBy("tag_id").agg(F.count(F.lit(1)).alias("doc_count"))
    return tags.join(counts, "tag_id", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))


def document_tag_lists(document_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags of each document as one list ordered by (name, id)."""
    joined = document_tags.join(tags.select("tag_id", F.col("name")), "tag_id")
    entry = F.struct("name", "tag_id", "status", "source", "similarity")
    return joined.groupBy("document_id").agg(F.array_sort(F.collect_list(entry)).alias("tags"))


def details(documents: DataFrame, current: DataFrame, tag_lists: DataFrame) -> DataFrame:
    """Catalogue rows with current version facts and tag lists joined once instead of looked up per row."""
    return documents.join(current, "document_id", "left").join(tag_lists, "document_id", "left")


def duplicate_titles(documents: DataFrame, groups: list[str]) -> DataFrame:
    """``(document_id, original_id, title, tier)`` where the caller may read the original too."""
    marked = documents.where(F.col("duplicate_of").isNotNull() & F.col("duplicate_tier").isNotNull())
    originals = readable(documents, groups).select(F.col("document_id").alias("original_id"), F.col("title").alias("original_title"))
    return marked.select("document_id", F.col("duplicate_of").alias("original_id"), F.col("duplicate_tier").alias("tier")).join(originals, "original_id")


# --- row changes ---------------------------------------------------------------


def upsert(current: DataFrame, changes: DataFrame, key: list[str], keep_when_null: tuple[str, ...] = ()) -> DataFrame:
    """Insert or overwrite by key; columns in ``keep_when_null`` keep the old value when the new one is null."""
    values = [c for c in current.columns if c not in key]
    old = current.select(*key, F.struct(*values).alias("_old"))
    new = changes.select(*key, F.struct(*values).alias("_new"))
    joined = old.join(new, key, "full_outer")

    def pick(name: str) -> Column:
        if name in keep_when_null:
            return F.coalesce(F.col(f"_new.{name}"), F.col(f"_old.{name}"))
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(f"_old.{name}"))

    return joined.select(*key, *[pick(v).alias(v) for v in values]).select(current.columns)


def update_fields(documents: DataFrame, changes: DataFrame, fields: list[str], now: Column) -> DataFrame:
    """Overlay the named fields of ``changes``; a field that must not be changed is an error."""
    unknown = sorted(set(fields) - UPDATABLE)
    if unknown:
        raise ValueError(f"unknown document fields: {unknown}")
    new = changes.select("document_id", F.struct(*fields).alias("_new"))
    joined = documents.join(new, "document_id", "left")
    touched = F.col("_new").isNotNull()
    updated = {f: F.when(touched, F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields}
    if "updated_at" in documents.columns:
        updated["updated_at"] = F.when(touched, now).otherwise(F.col("updated_at"))
    return joined.withColumns(updated).select(documents.columns)


def soft_delete(documents: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Mark live documents deleted; those already deleted keep their time."""
    gone = ids.select("document_id").distinct().withColumn("_gone", F.lit(True))
    joined = documents.join(gone, "document_id", "left")
    hit = F.col("_gone").isNotNull() & F.col("deleted_at").isNull()
    changed = {"deleted_at": F.when(hit, now).otherwise(F.col("deleted_at"))}
    if "updated_at" in documents.columns:
        changed["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    return joined.withColumns(changed).select(documents.columns)


def get_or_create_tags(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """Existing tags plus one new row per unseen (name, department), names compared without case.

    New ids continue after the largest id, in the order of the names. A null department only equals a null department.
    """
    asked = (
        wanted.select(collapse(F.col("name")).alias("name"), "department_id")
        .where("name <> ''")
        .groupBy(F.lower("name").alias("_key"), "department_id")
        .agg(F.min("name").alias("name"))
    )
    existing = tags.select(F.lower("name").alias("_have"), F.col("department_id").alias("_department"))
    fresh = asked.join(existing, (F.col("_key") == F.col("_have")) & F.col("department_id").eqNullSafe(F.col("_department")), "left_anti")
    top = tags.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("top"))
    numbered = running_number(fresh, [], F.substring("_key", 1, 2), [F.col("_key"), F.col("department_id")], "_n").withColumn("tag_id", F.col("_n") + top.scalar())
    return tags.unionByName(numbered.select("tag_id", "name", "department_id"), allowMissingColumns=True)


def replace_partition(current: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Drop everything stored for the keys present in ``rows`` and put ``rows`` in their place."""
    return current.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)
