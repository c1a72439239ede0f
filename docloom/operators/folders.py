"""The folder tree: descendants, paths, counts and safe changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import collapse
from docloom.operators.access import live
from docloom.session import cut_lineage

# Fixed values.
INBOX = "inbox"
ROOT_FOLDER = {"policy": "policies", "sop": "sops", "circular": "circulars", "guideline": "guidelines", "report": "reports", "minutes": "minutes"}
CIRCULAR_YEARS = {"2024": "circ-2024", "2026": "circ-2026"}
SOP_DEPARTMENTS = {"finance": "sop-fin", "hr": "sop-hr"}
MINUTES_FOLDER = "min-mgmt"
DEFAULT_FOLDERS = [
    ("inbox", "Inbox", None), ("policies", "Policies", None), ("sops", "SOPs", None), ("circulars", "Circulars", None),
    ("guidelines", "Guidelines", None), ("reports", "Reports", None), ("minutes", "Minutes", None), ("sop-fin", "Finance", "sops"),
    ("sop-hr", "Human resources", "sops"), ("circ-2024", "2024", "circulars"), ("circ-2026", "2026", "circulars"),
    ("min-mgmt", "Management meetings", "minutes"),
]
SLUG_CHARS = 40


def slug(name: Column) -> Column:
    dashed = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.btrim(F.substring(dashed, 1, SLUG_CHARS), F.lit("-"))
    return F.when(cut == "", "folder").otherwise(cut)


def new_folder_id(name: Column) -> Column:
    return F.concat(slug(name), F.lit("-"), F.substring(F.md5(F.uuid()), 1, 6))


def folder_name(name: Column) -> Column:
    return collapse(F.coalesce(name, F.lit("")))


def climbed(folders: DataFrame, stop: str | None = None) -> DataFrame:
    """``(folder_id, top, depth, path, cyclic)``: the topmost folder above each one, the steps to it, and the names on the way.

    ``path`` begins with the name of the topmost folder, or below it where ``top`` is a parent that no row has. ``stop`` counts as
    topmost whatever its parent. A folder that stands on a cycle or below one has no top and is ``cyclic``.

    Each round doubles the steps that a folder has climbed: it goes on from where its farthest known ancestor has got to.
    A tree of depth d takes about log2 d rounds; what still climbs after log2 of all folders is cyclic.
    """
    parent = F.col("parent_id") if stop is None else F.when(F.col("folder_id") != stop, F.col("parent_id"))
    state = folders.select(
        "folder_id", parent.alias("up"), F.when(parent.isNull(), F.col("folder_id")).alias("top"), parent.isNotNull().cast("int").alias("depth"), F.array("name").alias("path")
    )
    state = cut_lineage(state)
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.where("up is not null").isEmpty():
            break
        above = state.select(F.col("folder_id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        climbing = state.where("up is not null").join(above, "up", "left").select(
            "folder_id", F.col("_up").alias("up"), F.when(F.col("_path").isNull(), F.col("up")).otherwise(F.col("_top")).alias("top"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.concat(F.coalesce("_path", F.array().cast("array<string>")), "path").alias("path"),
        )
        state = cut_lineage(state.where("up is null").unionByName(climbing))
    cyclic = F.col("up").isNotNull()
    hidden = lambda c: F.when(~cyclic, F.col(c)).alias(c)
    return state.select("folder_id", hidden("top"), hidden("depth"), hidden("path"), cyclic.alias("cyclic"))


def descendants(folders: DataFrame, root: str) -> DataFrame:
    """``(folder_id, depth)`` below ``root``; cycles that don't hold it aren't below it."""
    below = climbed(folders, root).where((F.col("top") == root) & (F.col("folder_id") != root))
    return below.groupBy("folder_id").agg(F.min("depth").alias("depth"))


def paths(folders: DataFrame) -> DataFrame:
    """``(folder_id, path, cyclic)`` with names from the top; a folder whose parent is unknown is a top one, a cyclic one has no path."""
    return climbed(folders).select("folder_id", "path", "cyclic")


def with_counts(folders: DataFrame, documents: DataFrame, departments: list[str] | None = None) -> DataFrame:
    """Folders with the number of live readable documents directly inside, zeros kept."""
    rows = live(documents)
    if departments is not None:
        rows = rows.where(F.col("department_id").isin(departments))
    counts = rows.groupBy("folder_id").agg(F.count(F.lit(1)).alias("doc_count"))
    return folders.join(counts, "folder_id", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))


def folder_order() -> list[Column]:
    return [(F.col("folder_id") != INBOX).asc(), F.lower("name").asc(), F.col("folder_id").asc()]


def known_folder(documents: DataFrame, folders: DataFrame) -> DataFrame:
    """Replace folder ids that do not exist by the inbox."""
    have = folders.select("folder_id", F.lit(True).alias("_known"))
    joined = documents.join(have, "folder_id", "left")
    return joined.withColumn("folder_id", F.when(F.col("_known"), F.col("folder_id")).otherwise(F.lit(INBOX))).drop("_known")


def folder_candidates(doctype: Column, department: Column, effective_date: Column) -> Column:
    """Most specific folder first, then the type's own folder; empty for other types."""

    def pick(table: dict[str, str], value: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), value)

    specific = (
        F.when(doctype == "circular", pick(CIRCULAR_YEARS, F.substring(effective_date, 1, 4)))
        .when(doctype == "sop", pick(SOP_DEPARTMENTS, department))
        .when(doctype == "minutes", F.lit(MINUTES_FOLDER))
    )
    root = pick(ROOT_FOLDER, doctype)
    return F.when(root.isNotNull(), F.array_compact(F.array(specific, root))).otherwise(F.array().cast("array<string>"))


def auto_file(documents: DataFrame, folders: DataFrame) -> DataFrame:
    """File documents still in no folder or the inbox into their first existing candidate."""
    existing = folders.agg(F.collect_set("folder_id").alias("ids")).scalar()  # folder table: one row per folder
    candidates = folder_candidates(F.col("doctype"), F.col("department_id"), F.col("effective_date"))
    first = F.get(F.array_intersect(candidates, existing), 0)
    unfiled = F.col("folder_id").isNull() | (F.col("folder_id") == INBOX)
    fallback = F.coalesce("folder_id", F.when(F.array_contains(existing, F.lit(INBOX)), F.lit(INBOX)))
    return documents.withColumn("folder_id", F.when(unfiled, F.coalesce(first, fallback)).otherwise(F.col("folder_id")))


class FolderConflict(ValueError):
    """A sibling already has this name."""


class FolderCycle(ValueError):
    """A folder cannot move below itself."""


def check_change(folders: DataFrame, folder_id: str | None, name: str, parent_id: str | None) -> None:
    """Validate creating (``folder_id`` None), renaming or moving a folder."""
    if folder_id is not None and folders.where(F.col("folder_id") == folder_id).isEmpty():
        raise KeyError(folder_id)
    if parent_id is not None and folders.where(F.col("folder_id") == parent_id).isEmpty():
        raise KeyError(parent_id)
    if folder_id is not None and parent_id is not None:
        below = descendants(folders, folder_id).where(F.col("folder_id") == parent_id)
        if parent_id == folder_id or not below.isEmpty():
            raise FolderCycle(folder_id)
    siblings = folders.where(F.col("parent_id").eqNullSafe(F.lit(parent_id)) & (F.lower("name") == name.lower()))
    if folder_id is not None:
        siblings = siblings.where(F.col("folder_id") != folder_id)
    if not siblings.isEmpty():
        raise FolderConflict(name)


def create_folder(folders: DataFrame, name: str, parent_id: str | None = None) -> DataFrame:
    check_change(folders, None, name, parent_id)
    row = folders.sparkSession.range(1).select(
        new_folder_id(F.lit(name)).alias("folder_id"), F.lit(name).alias("name"), F.lit(parent_id).cast("string").alias("parent_id")
    )
    return folders.unionByName(row)


def change_folder(folders: DataFrame, folder_id: str, name: str | None = None, parent_id: str | None = None, move: bool = False) -> DataFrame:
    current = folders.where(F.col("folder_id") == folder_id).first()
    if current is None:
        raise KeyError(folder_id)
    new_name = name if name is not None else current["name"]
    new_parent = parent_id if move else current["parent_id"]
    check_change(folders, folder_id, new_name, new_parent)
    own = F.col("folder_id") == folder_id
    return folders.withColumns(
        {
            "name": F.when(own, F.lit(new_name)).otherwise(F.col("name")),
            "parent_id": F.when(own, F.lit(new_parent).cast("string")).otherwise(F.col("parent_id")),
        }
    )


def delete_folder(folders: DataFrame, documents: DataFrame, folder_id: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Remove a folder with everything below it; its documents are deleted and lose their folder."""
    gone = descendants(folders, folder_id).select("folder_id").union(folders.where(F.col("folder_id") == folder_id).select("folder_id"))
    flagged = documents.join(gone.withColumn("_gone", F.lit(True)), "folder_id", "left")
    inside = F.col("_gone").isNotNull()
    emptied = flagged.withColumns(
        {
            "deleted_at": F.when(inside & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at")),
            "folder_id": F.when(~inside, F.col("folder_id")),
        }
    ).select(documents.columns)
    return folders.join(gone, "folder_id", "left_anti"), emptied
