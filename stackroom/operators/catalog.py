"""Listings and counts over the document catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ilike_any

# Statuses always reported, final statuses, sortable fields.
COUNTED = ("indexed", "pending", "running", "failed", "deleted", "outdated")
TERMINAL = ("indexed", "failed", "deleted", "deleting", "outdated")
DOC_SORT = ("updated_at", "created_at", "title", "chunk_count", "file_size")
NULLS_LAST = ("chunk_count", "file_size", "last_synced_at")
KB_SORT = ("kb_id", "kb_name", "status", "created_at", "updated_at")
MAX_PAGE = 100


def status_counts(documents: DataFrame, owner: str) -> DataFrame:
    """One row per owner: the six counted statuses, all other statuses together, and the total."""
    known = [F.count_if(F.col("status") == s).alias(s) for s in COUNTED]
    return documents.groupBy(owner).agg(
        *known, F.count_if(~F.col("status").isin(*COUNTED)).alias("other"), F.count("*").alias("total"))


def all_status(owners: DataFrame, documents: DataFrame, owner: str) -> DataFrame:
    return owners.select(owner).join(status_counts(documents, owner), owner, "left").fillna(0)


def order_column(name: str, descending: bool) -> Column:
    if name in NULLS_LAST:
        return F.desc_nulls_last(name) if descending else F.asc_nulls_last(name)
    return F.desc_nulls_first(name) if descending else F.asc_nulls_last(name)


def list_docs_page(documents: DataFrame, page: int = 1, page_size: int = 20, sort_by: str = "updated_at",
                   descending: bool = True, search: str | None = None, search_id: bool = True,
                   include_deleted: bool = False, **equal: str | None) -> DataFrame:
    """One page of documents with the total before paging; ties are broken by document id."""
    if sort_by not in DOC_SORT:
        raise ValueError(f"cannot sort by {sort_by}")
    rows = documents if include_deleted else documents.filter(F.col("status") != "deleted")
    for column, value in equal.items():
        if value:
            rows = rows.filter(F.col(column) == value)
    if search:
        fields = ["title", "source"] + (["doc_id"] if search_id else [])
        rows = rows.filter(ilike_any(search, *[F.col(f) for f in fields]))
    size = min(page_size, MAX_PAGE)
    items = rows.orderBy(order_column(sort_by, descending), "doc_id").offset((page - 1) * size).limit(size)
    total = rows.agg(F.count("*").alias("total"))
    return items.join(F.broadcast(total))


def list_docs(documents: DataFrame, status: str | None = None, include_deleted: bool = False) -> DataFrame:
    rows = documents if include_deleted else documents.filter(F.col("status") != "deleted")
    rows = rows.filter(F.col("status") == status) if status else rows
    return rows.orderBy(F.desc("created_at"), "doc_id")


def list_kbs(kbs: DataFrame, sort_by: str = "kb_id", descending: bool = False) -> DataFrame:
    return kbs.orderBy(order_column(sort_by if sort_by in KB_SORT else "kb_id", descending), "kb_id")


def list_connectors(connectors: DataFrame, kb_ids: list[str] | None = None, source_type: str | None = None,
                    status: str | None = None, has_schedule: bool | None = None, search: str | None = None,
                    sort_by: str = "created_at", descending: bool = True) -> DataFrame:
    """Filtered connectors; an empty list of knowledge bases finds none."""
    rows = connectors
    if kb_ids is not None:
        rows = rows.filter(F.col("kb_id").isin(*kb_ids) if kb_ids else F.lit(False))
    if source_type is not None:
        rows = rows.filter(F.col("source_type") == source_type)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if has_schedule is not None:
        rows = rows.filter(F.col("sync_schedule").isNotNull() if has_schedule else F.col("sync_schedule").isNull())
    if search is not None:
        like = f"%{search.lower()}%"
        rows = rows.filter(F.lower("name").like(like) | F.lower("connector_id").like(like))
    return rows.orderBy(order_column(sort_by, descending), "connector_id")


def pending(documents: DataFrame, owner: str) -> DataFrame:
    """(owner, n_pending, n_active): not yet final, and pending or running."""
    return documents.groupBy(owner).agg(
        F.count_if(~F.col("status").isin(*TERMINAL)).alias("n_pending"),
        F.count_if(F.col("status").isin("pending", "running")).alias("n_active"))


def register_kbs(kbs: DataFrame, requests: DataFrame) -> DataFrame:
    """Insert absent knowledge bases; where one exists, given values update it.

    requests (kb_id, kb_name, description, tags): null leaves a value alone.
    """
    fields = [c for c in kbs.columns if c != "kb_id"]
    fresh = requests.select("kb_id", *[F.col(f).alias(f"new_{f}") for f in fields])
    return kbs.join(fresh, "kb_id", "full_outer").select(
        "kb_id", *[F.coalesce(f"new_{f}", f).alias(f) for f in fields])
