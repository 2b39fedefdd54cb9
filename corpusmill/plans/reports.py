"""Usage, value and failure reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import round_half_up
from corpusmill.operators.listing import live_facts
from corpusmill.operators.lookup import originals_retrieved
from corpusmill.operators.ranking import top_per_key
from corpusmill.schemas import MEMORY_STATUSES
from corpusmill.session import as_time


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def _total(column: str, name: str, where: Column | None = None) -> Column:
    value = F.col(column) if where is None else F.when(where, F.col(column))
    return F.coalesce(F.sum(value), F.lit(0)).alias(name)


def token_stats_columns() -> list[Column]:
    op = F.col("operation")
    return [
        _count(op == "compress", "compressions"),
        _count(op == "retrieve_original", "retrieves"),
        _count(op == "remember", "remembers"),
        _count(op == "recall", "recalls"),
        _count(op == "forget", "forgets"),
        _count(F.col("failed"), "failures"),
        _total("tokens_saved", "tokens_saved"),
        _total("tokens_before", "tokens_before"),
        _total("tokens_after", "tokens_after"),
        F.coalesce(F.avg("compression_ratio"), F.lit(0.0)).alias("avg_ratio"),
    ]


def token_stats(receipts: DataFrame) -> DataFrame:
    """D1; also valid on a receipt stream in update mode."""
    return receipts.groupBy("scope_id").agg(*token_stats_columns())


def value_summary(receipts: DataFrame) -> DataFrame:
    """D2."""
    op = F.col("operation")
    compress = op == "compress"
    return receipts.groupBy("scope_id").agg(
        _count(compress, "compressions"),
        _total("tokens_saved", "tokens_saved", compress),
        F.coalesce(F.avg(F.when(compress, F.col("compression_ratio"))), F.lit(0.0)).alias(
            "avg_ratio"
        ),
        _count(compress & F.col("cache_hit"), "cache_hits"),
        _count(op == "retrieve_original", "retrieves"),
        _count(op == "remember", "memories_saved"),
        _count(op == "recall", "memories_recalled"),
        _count(op == "forget", "memories_forgotten"),
        F.max("timestamp").alias("last_activity"),
    )


def recoverable_originals(originals: DataFrame, now: Column | str) -> DataFrame:
    """D3: originals in store and those not expired, per scope."""
    live = F.col("expires_at").isNull() | (F.col("expires_at") > as_time(now))
    return originals.groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("originals_stored"), _count(live, "recoverable_originals")
    )


def cache_stats(compressed: DataFrame) -> DataFrame:
    """D4."""
    return (
        compressed.filter(F.col("cache_key").isNotNull())
        .groupBy("scope_id")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            _total("cache_hit_count", "hits"),
            F.countDistinct("content_type").alias("content_types"),
            round_half_up(F.coalesce(F.avg("compression_ratio"), F.lit(0.0)), 4).alias("avg_ratio"),
        )
    )


def failure_stats(failures: DataFrame, now: Column | str) -> DataFrame:
    """Total, by type and by operation in one pass, with the last 24 hours."""
    recent = F.col("created_at") >= as_time(now) - F.expr("INTERVAL 24 HOURS")
    scope, kind, op = F.col("scope_id"), F.col("event_type"), F.col("operation")
    sets = failures.groupingSets([[scope], [scope, kind], [scope, op]], scope, kind, op)
    counted = sets.agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), _count(recent, "recent")
    )
    dimension = (
        F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "event_type").otherwise("operation")
    )
    return counted.select(
        "scope_id", dimension.alias("dimension"),
        F.coalesce("event_type", "operation", F.lit("all")).alias("value"), "n", "recent",
    )


def top_failing(failures: DataFrame, k: int = 10) -> DataFrame:
    """Compressed rows with the most failures, per scope."""
    counts = (
        failures.filter(F.col("ccr_id").isNotNull())
        .groupBy("scope_id", "ccr_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_per_key(counts, ["scope_id"], [F.col("n").desc(), F.col("ccr_id")], k)


def page_stats(compressed_page: DataFrame) -> DataFrame:
    """Totals over the rows of a listing page, per scope."""
    ratio = F.when(
        F.col("tokens_before") > 0, F.col("tokens_saved") / F.col("tokens_before")
    ).otherwise(F.lit(0.0))
    return compressed_page.groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("items"),
        _count(F.col("failed"), "failed"),
        _count(~F.col("failed"), "succeeded"),
        _total("tokens_saved", "tokens_saved"),
        _total("tokens_before", "tokens_before"),
        _total("tokens_after", "tokens_after"),
        round_half_up(F.avg(ratio), 4).alias("avg_ratio"),
    )


def memory_status_counts(memories: DataFrame) -> DataFrame:
    """One row per scope with a column per status."""
    counts = [_count(F.col("status") == s, s) for s in MEMORY_STATUSES]
    return memories.groupBy("scope_id").agg(F.count(F.lit(1)).alias("total"), *counts)


def memory_type_counts(memories: DataFrame) -> DataFrame:
    """Active memories by type."""
    active = memories.filter(F.col("status") == "active")
    return active.groupBy("scope_id", "type").agg(F.count(F.lit(1)).alias("n"))


def duplicate_fingerprints(memories: DataFrame) -> DataFrame:
    """One row, groups of active duplicates and the rows in them."""
    groups = (
        memories.filter(
            (F.col("status") == "active")
            & F.col("fingerprint").isNotNull()
            & (F.col("fingerprint") != "")
        )
        .groupBy("scope_id", "type", "fingerprint")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    return groups.agg(
        F.count(F.lit(1)).alias("duplicate_groups"), _total("n", "duplicate_rows")
    )


def profile(facts: DataFrame, now: Column | str) -> DataFrame:
    """The live facts of every scope with the profile's last update.

    Facts stay rows: a scope's facts are unbounded, so they are not collected
    into an array. Order by (layer, created_at desc, fact_id) when reading.
    """
    live = live_facts(facts, now)
    updated = live.groupBy("scope_id").agg(F.max("updated_at").alias("profile_updated_at"))
    return live.join(updated, "scope_id")


def profile_summary(facts: DataFrame, now: Column | str) -> DataFrame:
    """Fact counts by layer and the last update, one row per scope."""
    return (
        live_facts(facts, now)
        .groupBy("scope_id")
        .agg(
            _count(F.col("layer") == "static", "static_facts"),
            _count(F.col("layer") == "dynamic", "dynamic_facts"),
            F.max("updated_at").alias("updated_at"),
        )
    )


def last_update(memories: DataFrame, compressed: DataFrame) -> DataFrame:
    """The newest row of either table, per scope."""
    both = [
        t.groupBy("scope_id").agg(F.max("created_at").alias("at")) for t in (memories, compressed)
    ]
    return both[0].unionByName(both[1]).groupBy("scope_id").agg(F.max("at").alias("last_updated"))


def latest_retrieve(receipts: DataFrame) -> DataFrame:
    """The newest successful retrieval and what it returned."""
    done = receipts.filter((F.col("operation") == "retrieve_original") & ~F.col("failed"))
    newest = done.groupBy("scope_id").agg(
        F.max(
            F.struct(
                "timestamp",
                "receipt_id",
                F.try_element_at("original_refs", F.lit(1)).alias("original_ref"),
                F.coalesce(F.try_element_at("ccr_ids", F.lit(1)), F.lit("")).alias("ccr_id"),
            )
        ).alias("r")
    )
    return newest.select(
        "scope_id", F.col("r.timestamp").alias("retrieved_at"), "r.original_ref", "r.ccr_id"
    ).filter(F.col("original_ref").isNotNull())


def suggested_action(receipts: DataFrame, originals: DataFrame) -> DataFrame:
    """What a scope should try next, from its usage counters."""
    usage = value_summary(receipts)
    stored = originals.groupBy("scope_id").agg(F.count(F.lit(1)).alias("originals_stored"))
    joined = usage.join(stored, "scope_id", "left")
    some = F.col("compressions") > 0
    action = (
        F.when(some & (F.col("memories_saved") == 0), "remember")
        .when(some & (F.col("memories_saved") > 0) & (F.col("memories_recalled") == 0), "recall")
        .when(
            (F.col("retrieves") == 0) & (F.coalesce("originals_stored", F.lit(0)) > 0), "retrieve"
        )
        .when(F.col("compressions") > 5, "stats")
        .otherwise("compress")
    )
    return joined.select("scope_id", action.alias("action"))


def top_savings(compressed: DataFrame, k: int = 5) -> DataFrame:
    """the compressions that saved most, per scope."""
    rows = compressed.filter(~F.col("failed")).select(
        "scope_id", "ccr_id", "content_type", "tokens_before", "tokens_after", "tokens_saved",
        "compression_ratio", "created_at", "summary",
    )
    return top_per_key(rows, ["scope_id"], [F.col("tokens_saved").desc(), F.col("ccr_id")], k)


def recent_memories(memories: DataFrame, k: int = 10) -> DataFrame:
    """the newest active memories, per scope."""
    rows = memories.filter(F.col("status") == "active").select(
        "scope_id", "memory_id", "type", "summary", "created_at"
    )
    return top_per_key(rows, ["scope_id"], [F.col("created_at").desc(), F.col("memory_id")], k)


def important_memories(memories: DataFrame, k: int = 10, show: int = 5) -> DataFrame:
    """the most confident active memories; the first ``show`` of the top ``k``."""
    rows = memories.filter(F.col("status") == "active").select(
        "scope_id", "memory_id", "type", "confidence", "created_at",
        F.coalesce("summary", F.substring("content", 1, 80)).alias("summary"),
    )
    order = [F.col("confidence").desc(), F.col("memory_id")]
    return top_per_key(rows, ["scope_id"], order, min(k, show))


def retrieval_trust(receipts: DataFrame, originals: DataFrame) -> DataFrame:
    """C4 + D3 + D11: stored and retrieved originals with the latest proof."""
    stored = originals.groupBy("scope_id").agg(F.count(F.lit(1)).alias("originals_stored"))
    return (
        stored.join(originals_retrieved(receipts), "scope_id", "full_outer")
        .join(latest_retrieve(receipts), "scope_id", "left")
        .withColumns(
            {
                c: F.coalesce(c, F.lit(0))
                for c in ("originals_stored", "originals_retrieved")
            }
        )
    )
