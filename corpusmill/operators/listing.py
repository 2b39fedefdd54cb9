"""Listings, counts and ranged retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ranking import page
from corpusmill.session import as_time


def in_scope(df: DataFrame, scope_id: str) -> DataFrame:
    """B1: scope isolation; prunes partitions of a table laid out by scope."""
    return df.filter(F.col("scope_id") == scope_id)


def _where(df: DataFrame, **allowed: Sequence[str] | None) -> DataFrame:
    for column, values in allowed.items():
        if values:
            df = df.filter(F.col(column).isin(*values))
    return df


MEMORY_SORTS = ("created_at", "updated_at", "type", "status", "confidence")


def list_memories(
    memories: DataFrame,
    types: Sequence[str] | None = None,
    statuses: Sequence[str] | None = None,
    sort_by: str = "created_at",
    descending: bool = True,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """B2: a page of memories per scope."""
    if sort_by not in MEMORY_SORTS:
        raise ValueError(f"cannot sort by {sort_by}")
    rows = _where(memories, type=types, status=statuses)
    return page(rows, "memory_id", [(sort_by, descending)], limit, offset)


def list_compressed(
    compressed: DataFrame, content_types: Sequence[str] | None = None, limit: int = 20, offset: int = 0
) -> DataFrame:
    """Newest first."""
    rows = _where(compressed, content_type=content_types)
    return page(rows, "ccr_id", [("created_at", True)], limit, offset)


def list_receipts(
    receipts: DataFrame,
    operations: Sequence[str] | None = None,
    event_types: Sequence[str] | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """Newest first per scope."""
    rows = _where(receipts, operation=operations, event_type=event_types)
    return page(rows, "receipt_id", [("timestamp", True)], limit, offset)


def list_run_receipts(receipts: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Oldest first per run."""
    rows = receipts.filter(F.col("run_id").isNotNull())
    return page(rows, "receipt_id", [("timestamp", False)], limit, offset, keys=("run_id",))


def list_failures(
    failures: DataFrame,
    event_types: Sequence[str] | None = None,
    operations: Sequence[str] | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """Newest first."""
    rows = _where(failures, event_type=event_types, operation=operations)
    return page(rows, "failure_id", [("created_at", True)], limit, offset)


def live_facts(facts: DataFrame, now: Column | str) -> DataFrame:
    """Facts are live while expires_at is unset or strictly after now."""
    return facts.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_time(now)))


def list_profile_facts(
    facts: DataFrame,
    now: Column | str,
    layers: Sequence[str] | None = None,
    source_memory_ids: Sequence[str] | None = None,
    active_only: bool = True,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """Newest first."""
    rows = _where(facts, layer=layers, source_memory_id=source_memory_ids)
    rows = live_facts(rows, now) if active_only else rows
    return page(rows, "fact_id", [("created_at", True)], limit, offset)


def list_cache_entries(compressed: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Last accessed first, never accessed last, then newest."""
    rows = compressed.filter(F.col("cache_key").isNotNull())
    order = [("last_accessed_at", True), ("created_at", True)]
    return page(rows, "ccr_id", order, limit, offset)


def retrieve_ranges(requests: DataFrame, originals: DataFrame) -> DataFrame:
    """Slice of an original per request (original_ref, offset, limit).

    A null limit reads to the end. Requests of another scope find nothing.
    """
    stored = originals.select(
        F.col("original_id").alias("original_ref"), "scope_id", "ccr_id", "content_type",
        "content", "tokens",
    )
    total = F.length("content")
    start = F.greatest(F.lit(0), F.least(F.coalesce(F.col("offset"), F.lit(0)), total)).cast("int")
    limit = F.greatest(F.lit(0), F.col("limit"))
    want = F.when(F.col("limit").isNull(), total).otherwise(limit).cast("int")
    piece = F.substring(F.col("content"), F.col("start") + 1, F.col("want"))
    return (
        requests.join(stored, ["original_ref", "scope_id"])
        .withColumns({"start": start, "want": want, "total_chars": total.cast("bigint")})
        .withColumn("slice", piece)
        .withColumn("returned_chars", F.length("slice").cast("bigint"))
        .withColumn("has_more", F.col("start") + F.col("returned_chars") < F.col("total_chars"))
        .drop("content", "want", "offset")
        .withColumnRenamed("start", "offset")
    )


def retrieve_status(requests: DataFrame, originals: DataFrame, compressed: DataFrame) -> DataFrame:
    """Ok, scope_mismatch, original_deleted or original_not_found."""
    stored = originals.select(
        F.col("original_id").alias("original_ref"), F.col("scope_id").alias("actual_scope_id")
    )
    known = compressed.groupBy("original_ref").agg(
        F.min_by("can_retrieve_original", "ccr_id").alias("_retrievable")
    )
    status = (
        F.when(F.col("actual_scope_id") == F.col("scope_id"), "ok")
        .when(F.col("actual_scope_id").isNotNull(), "scope_mismatch")
        .when(~F.col("_retrievable"), "original_deleted")
        .otherwise("original_not_found")
    )
    return (
        requests.join(stored, "original_ref", "left")
        .join(known, "original_ref", "left")
        .withColumn("status", status)
        .drop("_retrievable")
    )


def count_rows(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per scope, optionally by further columns."""
    return df.groupBy("scope_id", *by).agg(F.count(F.lit(1)).alias("n"))
