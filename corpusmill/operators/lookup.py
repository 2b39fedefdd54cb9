"""Joins between the tables of the data model.

All are equi joins on the scope and a further key. No side is hinted: Spark
broadcasts one only when it has measured it as small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import is_blank, parse_source_ref
from corpusmill.operators.ranking import top_per_key
from corpusmill.schemas import MEMORY_STATUSES

# Allowed status changes.
TRANSITIONS = {
    "active": ("superseded", "forgotten", "expired"),
    "superseded": ("active",),
    "forgotten": ("active",),
    "expired": ("active",),
}


def transition_table(spark: SparkSession) -> DataFrame:
    """The allowed (from_status, to_status) pairs."""
    pairs = [(a, b) for a in MEMORY_STATUSES for b in TRANSITIONS[a]]
    return spark.createDataFrame(pairs, "from_status string, to_status string")


def valid_transition(before: Column, after: Column) -> Column:
    """M4 / C12 as a column: the table is six pairs, so no join is needed."""
    allowed = [
        (before == F.lit(a)) & after.isin(*targets) for a, targets in TRANSITIONS.items()
    ]
    result = allowed[0]
    for more in allowed[1:]:
        result = result | more
    return F.coalesce(result, F.lit(False))


def top_facts(facts: DataFrame, memories: DataFrame, layer: str, k: int) -> DataFrame:
    """A scope's best facts of a layer by their active source memory."""
    sources = memories.filter(F.col("status") == "active").select(
        F.col("memory_id").alias("source_memory_id"), "type", "summary",
        F.substring("content", 1, 80).alias("excerpt"),
        F.col("confidence").alias("memory_confidence"),
        F.col("created_at").alias("memory_created_at"),
    )
    joined = (
        facts.filter(F.col("layer") == layer)
        .select("scope_id", "fact_id", "source_memory_id")
        .join(sources, "source_memory_id")
    )
    newest = F.col("memory_created_at").desc()
    by = [newest] if layer == "dynamic" else [F.col("memory_confidence").desc(), newest]
    return top_per_key(joined, ["scope_id"], [*by, F.col("fact_id")], k)


def rule_usage(memories: DataFrame, receipts: DataFrame, k: int = 3) -> DataFrame:
    """A scope's active project rules most often named by recall receipts."""
    used = (
        receipts.filter(F.col("operation") == "recall")
        .select("scope_id", "receipt_id", "timestamp",
                F.explode(F.array_distinct("memory_ids")).alias("memory_id"))
        .groupBy("scope_id", "memory_id")
        .agg(F.count(F.lit(1)).alias("recall_count"), F.max("timestamp").alias("last_recalled"))
    )
    rules = memories.filter(
        (F.col("type") == "project_rule") & (F.col("status") == "active")
    ).select("scope_id", "memory_id")
    counted = rules.join(used, ["scope_id", "memory_id"], "left").withColumn(
        "recall_count", F.coalesce("recall_count", F.lit(0))
    )
    order = [
        F.col("recall_count").desc(), F.col("last_recalled").desc_nulls_last(), F.col("memory_id")
    ]
    return top_per_key(counted, ["scope_id"], order, k)


def originals_retrieved(receipts: DataFrame) -> DataFrame:
    """C4: distinct originals named by successful retrievals, per scope."""
    done = receipts.filter((F.col("operation") == "retrieve_original") & ~F.col("failed"))
    refs = done.select("scope_id", F.explode("original_refs").alias("original_ref"))
    return refs.groupBy("scope_id").agg(
        F.countDistinct("original_ref").alias("originals_retrieved")
    )


def cached_originals(originals: DataFrame, compressed: DataFrame) -> DataFrame:
    """Originals that belong to a cache entry."""
    cached = compressed.filter(F.col("cache_key").isNotNull()).select("ccr_id")
    return originals.join(cached, "ccr_id", "left_semi")


def without_originals(compressed: DataFrame, originals: DataFrame) -> DataFrame:
    """Compressed rows that have no original left."""
    return compressed.join(originals.select("ccr_id").distinct(), "ccr_id", "left_anti")


def _reference_links(references: DataFrame, compressed: DataFrame) -> DataFrame:
    """Distinct (scope_id, source_ref) to ccr_id in three tiers.

    The references are made distinct first, so that a reference shared by many
    memories is matched once, however many rows carry it.
    """
    parsed = (
        references.filter(~is_blank(F.col("source_ref")))
        .select("scope_id", "source_ref")
        .distinct()
        .withColumn("_p", parse_source_ref(F.col("source_ref")))
    )
    value = F.col("_p.value")
    has_value = F.length(value) > 0
    by_id = (F.col("_p.prefix") == "ccr") & has_value
    by_original = (F.col("_p.prefix") == "orig") & has_value
    kinds = parsed.select(
        "scope_id", "source_ref",
        F.when(by_id, "ccr").when(by_original, "orig").otherwise("any").alias("tier"),
        F.when(by_id | by_original, value).otherwise(F.col("source_ref")).alias("_key"),
    )
    # every name a compressed row answers to, by tier
    names = compressed.select(
        "scope_id", "ccr_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("ccr").alias("tier"), F.col("ccr_id").alias("_key")),
                    _name("orig", "original_ref"),
                    _name("any", "source_ref"),
                    F.when(
                        ~F.col("original_ref").eqNullSafe(F.col("source_ref")),
                        _name("any", "original_ref"),
                    ),
                )
            )
        ).alias("_n"),
    ).select("scope_id", "ccr_id", "_n.*")
    return kinds.join(names, ["scope_id", "tier", "_key"]).select(
        "scope_id", "source_ref", "ccr_id"
    )


def _name(tier: str, column: str) -> Column:
    c = F.col(column)
    return F.when(c.isNotNull(), F.struct(F.lit(tier).alias("tier"), c.alias("_key")))


def related_compressed(references: DataFrame, compressed: DataFrame) -> DataFrame:
    """Compressed rows a source reference leads to, one row per pair."""
    links = _reference_links(references, compressed)
    details = compressed.select(
        "scope_id", "ccr_id", "summary", "original_ref", "can_retrieve_original"
    )
    return links.join(details, ["scope_id", "ccr_id"])


def with_can_expand(memories: DataFrame, compressed: DataFrame) -> DataFrame:
    """Does the memory's reference lead to a retrievable original?"""
    usable = compressed.filter(F.col("can_retrieve_original"))
    reachable = (
        _reference_links(memories, usable)
        .select("scope_id", "source_ref", F.lit(True).alias("_reach"))
        .distinct()
    )
    return (
        memories.join(reachable, ["scope_id", "source_ref"], "left")
        .withColumn("can_expand", F.coalesce("_reach", F.lit(False)))
        .drop("_reach")
    )


def with_originals(related: DataFrame, originals: DataFrame) -> DataFrame:
    """Add the original's text where the row may be retrieved."""
    stored = originals.select(
        "scope_id", F.col("original_id").alias("original_ref"),
        F.col("content").alias("original_content"), F.col("tokens").alias("original_tokens"),
        F.col("content_hash").alias("original_hash"),
    )
    allowed = F.when(F.col("can_retrieve_original"), F.col("original_ref"))
    keyed = related.withColumn("_ref", allowed)
    stored = stored.withColumnRenamed("original_ref", "_ref")
    return keyed.join(stored, ["scope_id", "_ref"], "left").drop("_ref")


def superseded_by(memories: DataFrame) -> DataFrame:
    """(memory_id, supersedes_id) pairs within a scope."""
    old = memories.filter(F.col("superseded_by").isNotNull()).select(
        "scope_id", F.col("superseded_by").alias("memory_id"), F.col("memory_id").alias("supersedes_id")
    )
    return memories.select("scope_id", "memory_id").join(old, ["scope_id", "memory_id"])


def recent_recalls(
    receipts: DataFrame, memories: DataFrame, recalls: int = 5, per_recall: int = 2
) -> DataFrame:
    """C11: the memories named first by a scope's newest recall receipts."""
    named = receipts.filter((F.col("operation") == "recall") & F.col("memory_ids").isNotNull())
    newest = top_per_key(
        named.select("scope_id", "receipt_id", "timestamp", "memory_ids"),
        ["scope_id"], [F.col("timestamp").desc(), F.col("receipt_id")], recalls, "recall_rank",
    )
    ids = newest.select(
        "scope_id", "recall_rank", F.col("timestamp").alias("recalled_at"),
        F.posexplode(F.slice("memory_ids", 1, per_recall)).alias("position", "memory_id"),
    )
    return ids.join(
        memories.select("scope_id", "memory_id", "type", "summary"), ["scope_id", "memory_id"]
    )
