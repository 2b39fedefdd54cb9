"""Quality of compression and recall against expectations (Q1-Q5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import content_hash, round_half_up


def key_fact_retention(results: DataFrame, expectations: DataFrame) -> DataFrame:
    """Q1, per case: facts kept and tokens saved.

    ``results``: case_id, content_type, compressed_content, compression_ratio;
    ``expectations``: case_id, key_facts. Conversations ignore case.
    """
    joined = results.join(expectations, "case_id")
    fold = F.col("content_type") == "conversation_history"
    hay = F.when(fold, F.lower("compressed_content")).otherwise(F.col("compressed_content"))
    kept = F.size(
        F.filter("key_facts", lambda f: F.contains(F.col("_hay"), F.when(fold, F.lower(f)).otherwise(f)))
    )
    total = F.size("key_facts")
    return joined.withColumn("_hay", hay).select(
        "case_id", "content_type", total.alias("facts_total"), kept.alias("facts_retained"),
        F.when(total > 0, kept / total).otherwise(0.0).alias("retention_rate"), "compression_ratio",
    )


def retention_summary(cases: DataFrame) -> DataFrame:
    """Q1: averages over all cases, one row."""
    return cases.agg(
        F.count(F.lit(1)).alias("cases"),
        round_half_up(F.avg("retention_rate"), 4).alias("avg_retention"),
        round_half_up(F.avg("compression_ratio"), 4).alias("avg_savings"),
    )


# Savings a type must reach where a case names none.
MIN_SAVINGS = {
    "test_output": 0.30, "log": 0.10, "command_output": 0.00, "code": 0.45, "json": 0.10,
    "markdown": 0.40, "rag_chunk": 0.35, "conversation_history": 0.50,
}


def gate_budget(tokens: Column, min_ratio: Column) -> Column:
    """Q2: the token budget a case is compressed to."""
    return F.greatest(F.lit(300), F.floor(tokens * (1 - min_ratio)))


def compression_gate(results: DataFrame, expectations: DataFrame, originals: DataFrame) -> DataFrame:
    """Q2, per case: kept, invented, savings and recoverability checks.

    ``expectations``: case_id, content (the input), must_keep, must_not_invent,
    min_savings. ``originals``: case_id with the stored content.
    """
    default = F.lit(0.0)
    for kind, value in MIN_SAVINGS.items():
        default = F.when(F.col("content_type") == kind, value).otherwise(default)
    stored = originals.select("case_id", F.col("content").alias("_stored"))
    joined = results.join(expectations, "case_id").join(stored, "case_id", "left")
    low = F.lower("compressed_content")
    checks = joined.withColumns(
        {
            "keeps_facts": F.forall("must_keep", lambda k: F.contains(low, F.lower(k))),
            "invents_nothing": ~F.exists(
                "must_not_invent", lambda k: F.contains(F.col("compressed_content"), k)
            ),
            "saves_enough": F.when(F.col("tokens_before") > 0, F.col("tokens_saved") / F.col("tokens_before"))
            .otherwise(0.0)
            >= F.coalesce("min_savings", default),
            "recoverable": F.coalesce(
                (content_hash(F.col("_stored")) == content_hash(F.col("content")))
                & (F.length("_stored") == F.length("content")),
                F.lit(False),
            ),
        }
    )
    passed = (
        ~F.col("failed") & F.col("keeps_facts") & F.col("invents_nothing") & F.col("saves_enough")
        & F.col("recoverable")
    )
    return checks.withColumn("passed", passed).select(
        "case_id", "content_type", "keeps_facts", "invents_nothing", "saves_enough", "recoverable",
        "passed",
    )


def recall_ranks(hits: DataFrame, memories: DataFrame, expectations: DataFrame) -> DataFrame:
    """Q3, per query: the best rank of a hit that contains the target text."""
    # targets go to the memories: the same few long memories are hits of many queries
    wanted = hits.select("query_id", "scope_id", "memory_id", "rank").join(expectations.select("query_id", "target_content"), "query_id")
    found = (
        wanted.join(memories.select("scope_id", "memory_id", "content"), ["scope_id", "memory_id"])
        .filter(F.contains("content", "target_content"))
        .groupBy("query_id")
        .agg(F.min("rank").alias("rank_found"))
    )
    ranked = expectations.select("query_id", "kind").join(found, "query_id", "left")
    return ranked.withColumns(
        {
            "in_top_1": F.coalesce(F.col("rank_found") == 1, F.lit(False)),
            "in_top_3": F.coalesce(F.col("rank_found") <= 3, F.lit(False)),
        }
    )


def recall_rates(ranks: DataFrame, hits: DataFrame, negatives: DataFrame) -> DataFrame:
    """Q3: Recall@1 and @3 by kind of query, and the share of negatives with hits."""
    rates = ranks.groupBy("kind").agg(
        F.count(F.lit(1)).alias("queries"),
        round_half_up(F.avg(F.col("in_top_1").cast("double")), 4).alias("recall_at_1"),
        round_half_up(F.avg(F.col("in_top_3").cast("double")), 4).alias("recall_at_3"),
    )
    answered = hits.select("query_id").distinct().withColumn("_hit", F.lit(1.0))
    wrong = negatives.select("query_id").join(answered, "query_id", "left").agg(
        F.lit("negative").alias("kind"),
        F.count(F.lit(1)).alias("queries"),
        round_half_up(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0.0))), F.lit(0.0)), 4).alias("false_recall"),
    )
    return rates.unionByName(wrong, allowMissingColumns=True)


def leaks(hits: DataFrame, queries: DataFrame, memories: DataFrame) -> DataFrame:
    """Q4: one row, hits of another scope, hits not active, and repeated hits."""
    owners = memories.select(
        "memory_id", F.col("scope_id").alias("_owner"), F.col("status").alias("_status")
    )
    asked = queries.select("query_id", F.col("scope_id").alias("_asked"))
    judged = hits.select("query_id", "memory_id").join(owners, "memory_id").join(asked, "query_id")
    pairs = judged.groupBy("query_id", "memory_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max((F.col("_owner") != F.col("_asked")).cast("int")).alias("_foreign"),
        F.max((F.col("_status") != "active").cast("int")).alias("_inactive"),
    )
    zero = F.lit(0)
    return pairs.agg(
        F.coalesce(F.sum("_foreign"), zero).alias("cross_scope"),
        F.coalesce(F.sum("_inactive"), zero).alias("non_active"),
        F.count_if(F.col("_n") > 1).alias("duplicates"),
    )


def verdict(
    rates: DataFrame, leak_counts: DataFrame, at_1: float = 0.80, at_3: float = 0.95
) -> DataFrame:
    """Q5: one row of pass flags from precision and broad recall and the leak counts."""
    best = rates.agg(
        F.max(F.when(F.col("kind") == "precision", F.col("recall_at_1"))).alias("recall_at_1"),
        F.max(F.when(F.col("kind") == "broad", F.col("recall_at_3"))).alias("recall_at_3"),
    )
    flags = best.select(
        (F.col("recall_at_1") >= at_1).alias("recall_at_1_pass"),
        (F.col("recall_at_3") >= at_3).alias("recall_at_3_pass"),
        (leak_counts.select("cross_scope").scalar() == 0).alias("no_cross_scope"),
        (leak_counts.select("non_active").scalar() == 0).alias("no_non_active"),
        (leak_counts.select("duplicates").scalar() == 0).alias("no_duplicates"),
    )
    every = F.lit(True)
    for name in flags.columns:
        every = every & F.col(name)
    return flags.withColumn("passed", F.coalesce(every, F.lit(False)))
