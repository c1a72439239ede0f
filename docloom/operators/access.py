"""Who may see what: the access predicate and the attribute filters built on top of it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
WRITER_ROLES = ("contributor", "admin")
DOCTYPES = ("policy", "sop", "circular", "guideline", "report", "minutes", "other")


@dataclass(frozen=True)
class User:
    user_id: str
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def groups(self) -> list[str]:
        return sorted(set(self.roles))


@dataclass(frozen=True)
class Filters:
    doctype: list[str] | None = None
    department_id: list[str] | None = None
    document_ids: list | None = None
    tags: list[str] | None = None
    date_from: str | None = None
    date_to: str | None = None
    include_superseded: bool = True


def allowed(groups: list[str], column: str = "allowed_groups") -> Column:
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(g) for g in groups]).cast("array<string>"))


def search_filter(groups: list[str], filters: Filters | None = None, leaf_only: bool = False) -> Column:
    """The access clause is always there; an empty list adds no clause; date bounds are inclusive."""
    clause = allowed(groups)
    if filters is not None:
        for column, values in (("doctype", filters.doctype), ("department_id", filters.department_id), ("document_id", filters.document_ids)):
            if values:
                clause &= F.col(column).isin(list(values))
        if filters.tags:
            clause &= F.arrays_overlap(F.col("tags"), F.array(*[F.lit(t) for t in filters.tags]))
        effective = F.try_to_date(F.col("effective_date"))
        if filters.date_from:
            clause &= effective >= F.lit(filters.date_from).cast("date")
        if filters.date_to:
            clause &= effective <= F.lit(filters.date_to).cast("date")
        if not filters.include_superseded:
            clause &= ~F.col("superseded")
    if leaf_only:
        clause &= F.col("level") == 0
    return clause


def live(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("deleted_at").isNull())


def readable(documents: DataFrame, groups: list[str]) -> DataFrame:
    """Authoritative check against the catalogue: live rows of the caller's departments."""
    return live(documents).where(F.col("department_id").isin(groups))


def writable(documents: DataFrame, memberships: DataFrame, user_id: str) -> DataFrame:
    roles = memberships.where((F.col("user_id") == user_id) & F.col("role").isin(*WRITER_ROLES)).select("department_id")
    return live(documents).join(roles, "department_id", "left_semi")


def user_departments(users: DataFrame, memberships: DataFrame, departments: DataFrame) -> DataFrame:
    """One row per user with the sorted (department, name, role) list."""
    joined = users.join(memberships, "user_id").join(departments, "department_id")
    entries = F.array_sort(F.collect_list(F.struct("department_id", "department_name", "role")))
    return joined.groupBy("user_id", "username").agg(entries.alias("departments"))


def visible_tags(tags: DataFrame, groups: list[str]) -> DataFrame:
    return tags.where(F.col("department_id").isNull() | F.col("department_id").isin(groups))


def narrow_scope(scope: Filters | None, doctype: str | None) -> tuple[Filters | None, bool]:
    """Combine a caller's scope with a requested type; the flag is False when they contradict."""
    wanted = doctype if doctype in DOCTYPES else None
    if wanted is None:
        return scope, True
    if scope is None:
        return Filters(doctype=[wanted]), True
    if scope.doctype and wanted not in scope.doctype:
        return None, False
    return replace(scope, doctype=[wanted]), True
