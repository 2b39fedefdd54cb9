"""Project overview and brief, one row or a few rows per scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.lookup import top_facts
from corpusmill.plans import reports as R


def overview(
    memories: DataFrame, compressed: DataFrame, originals: DataFrame, receipts: DataFrame
) -> DataFrame:
    """Counts, token savings and last update of every scope.

    Each input is aggregated to one row per scope before the joins.
    """
    ccr = compressed.groupBy("scope_id").agg(F.count(F.lit(1)).alias("compressions"))
    stored = originals.groupBy("scope_id").agg(F.count(F.lit(1)).alias("originals"))
    tokens = R.token_stats(receipts).select(
        "scope_id", F.col("tokens_saved"), F.col("avg_ratio").alias("avg_compression_ratio")
    )
    parts = [R.memory_status_counts(memories), ccr, stored, tokens, R.last_update(memories, compressed)]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "scope_id", "full_outer")
    counts = [
        "total", "active", "superseded", "forgotten", "expired", "compressions", "originals",
        "tokens_saved",
    ]
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def brief(memories: DataFrame, facts: DataFrame) -> DataFrame:
    """What to tell about a scope: three rules, and top memories of distinct types.

    Of the five most confident active memories the first three count; a type
    that was shown before is left out.
    """
    rules = top_facts(facts, memories, "static", 3).select(
        "scope_id", F.lit("rule").alias("part"), "rank", "type",
        F.coalesce("summary", F.substring("excerpt", 1, 60)).alias("text"),
    )
    best = R.important_memories(memories, k=5, show=3)
    first = best.groupBy("scope_id", "type").agg(
        F.min_by(F.struct("rank", "summary"), "rank").alias("_m")
    )
    shown = first.select(
        "scope_id", F.lit("memory").alias("part"), F.col("_m.rank").alias("rank"), "type",
        F.col("_m.summary").alias("text"),
    )
    return rules.unionByName(shown)
