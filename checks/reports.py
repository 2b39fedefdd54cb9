"""Queries over the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, round_sql
from corpusmill.functions.text import round_half_up
from corpusmill.operators.listing import list_compressed
from corpusmill.operators.ranking import nearest_rank
from corpusmill.plans import reports as R
from corpusmill.sources import testdata as td


def _r(df, *columns, digits=6):
    """Averages of doubles depend on the order of addition: compare six digits."""
    return df.withColumns({c: round_half_up(F.col(c), digits) for c in columns})


@query("token_stats", f"""
  SELECT scope_id, count_if(operation = 'compress') AS compressions, count_if(operation = 'retrieve_original') AS retrieves,
    count_if(operation = 'remember') AS remembers, count_if(operation = 'recall') AS recalls,
    count_if(operation = 'forget') AS forgets, count_if(failed) AS failures,
    CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved, CAST(sum(tokens_before) AS BIGINT) AS tokens_before,
    CAST(sum(tokens_after) AS BIGINT) AS tokens_after, {round_sql('avg(compression_ratio)', 6)} AS avg_ratio
  FROM t_rcp GROUP BY scope_id""")
def token_stats(spark, sf):
    return _r(R.token_stats(td.receipts(spark, sf)), "avg_ratio")


@query("value_summary", f"""
  SELECT scope_id, count_if(operation = 'compress') AS compressions,
    CAST(coalesce(sum(CASE WHEN operation = 'compress' THEN tokens_saved END), 0) AS BIGINT) AS tokens_saved,
    {round_sql("coalesce(avg(CASE WHEN operation = 'compress' THEN compression_ratio END), 0)", 6)} AS avg_ratio,
    count_if(operation = 'compress' AND cache_hit) AS cache_hits, count_if(operation = 'retrieve_original') AS retrieves,
    count_if(operation = 'remember') AS memories_saved, count_if(operation = 'recall') AS memories_recalled,
    count_if(operation = 'forget') AS memories_forgotten, CAST(max(timestamp) AS VARCHAR) AS last_activity
  FROM t_rcp GROUP BY scope_id""")
def value_summary(spark, sf):
    summary = _r(R.value_summary(td.receipts(spark, sf)), "avg_ratio")
    return summary.withColumn("last_activity", F.col("last_activity").cast("string"))


@query("recoverable_originals", """
  SELECT scope_id, count(*) AS originals_stored,
    count_if(expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-01') AS recoverable_originals
  FROM t_orig GROUP BY scope_id""")
def recoverable_originals(spark, sf):
    return R.recoverable_originals(td.originals(spark, sf), td.NOW)


@query("cache_stats", f"""
  SELECT scope_id, count(*) AS entries, CAST(sum(cache_hit_count) AS BIGINT) AS hits,
    count(DISTINCT content_type) AS content_types, {round_sql('avg(compression_ratio)', 4)} AS avg_ratio
  FROM t_ccr WHERE cache_key IS NOT NULL GROUP BY scope_id""")
def cache_stats(spark, sf):
    return R.cache_stats(td.compressed(spark, sf))


@query("failure_stats", """
  SELECT scope_id, CASE grouping_id(event_type, operation) WHEN 3 THEN 'total' WHEN 1 THEN 'event_type' ELSE 'operation' END AS dimension,
    coalesce(event_type, operation, 'all') AS value, count(*) AS n,
    count_if(created_at >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR) AS recent
  FROM t_fail GROUP BY GROUPING SETS ((scope_id), (scope_id, event_type), (scope_id, operation))""")
def failure_stats(spark, sf):
    return R.failure_stats(td.failures(spark, sf), "2024-01-30 00:00:00")


@query("top_failing", """
  SELECT scope_id, ccr_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY n DESC, ccr_id) AS rank
    FROM (SELECT scope_id, ccr_id, count(*) AS n FROM t_fail WHERE ccr_id IS NOT NULL GROUP BY ALL)) WHERE rank <= 10""")
def top_failing(spark, sf):
    return R.top_failing(td.failures(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("page_stats", f"""
  SELECT scope_id, count(*) AS items, count_if(failed) AS failed, count_if(NOT failed) AS succeeded,
    CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved, CAST(sum(tokens_before) AS BIGINT) AS tokens_before,
    CAST(sum(tokens_after) AS BIGINT) AS tokens_after,
    {round_sql('avg(CASE WHEN tokens_before > 0 THEN tokens_saved / tokens_before ELSE 0 END)', 4)} AS avg_ratio
  FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC, ccr_id) AS r FROM t_ccr)
  WHERE r <= 20 GROUP BY scope_id""")
def page_stats(spark, sf):
    return R.page_stats(list_compressed(td.compressed(spark, sf)))


@query("memory_status_counts", """
  SELECT scope_id, count(*) AS total, count_if(status = 'active') AS active, count_if(status = 'superseded') AS superseded,
    count_if(status = 'forgotten') AS forgotten, count_if(status = 'expired') AS expired FROM t_mem GROUP BY scope_id""")
def memory_status_counts(spark, sf):
    return R.memory_status_counts(td.memories(spark, sf))


@query("memory_type_counts", "SELECT scope_id, type, count(*) AS n FROM t_mem WHERE status = 'active' GROUP BY ALL")
def memory_type_counts(spark, sf):
    return R.memory_type_counts(td.memories(spark, sf))


@query("duplicate_fingerprints", """
  SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows FROM (
    SELECT count(*) AS n FROM t_mem WHERE status = 'active' AND fingerprint IS NOT NULL AND fingerprint != ''
    GROUP BY scope_id, type, fingerprint HAVING count(*) > 1)""")
def duplicate_fingerprints(spark, sf):
    return R.duplicate_fingerprints(td.memories(spark, sf))


_LIVE = "(expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-01')"


@query("profile", f"""
  SELECT scope_id, layer, fact_id, content, CAST(max(updated_at) OVER (PARTITION BY scope_id) AS VARCHAR) AS profile_updated_at
  FROM t_fact WHERE {_LIVE}""")
def profile(spark, sf):
    return R.profile(td.profile_facts(spark, sf), td.NOW).select(
        "scope_id", "layer", "fact_id", "content",
        F.col("profile_updated_at").cast("string").alias("profile_updated_at"))


@query("profile_summary", f"""
  SELECT scope_id, count_if(layer = 'static') AS static_facts, count_if(layer = 'dynamic') AS dynamic_facts,
    CAST(max(updated_at) AS VARCHAR) AS updated_at FROM t_fact WHERE {_LIVE} GROUP BY scope_id""")
def profile_summary(spark, sf):
    return R.profile_summary(td.profile_facts(spark, sf), td.NOW).withColumn(
        "updated_at", F.col("updated_at").cast("string"))


@query("last_update", """
  SELECT scope_id, CAST(max(newest) AS VARCHAR) AS last_updated FROM (
    SELECT scope_id, max(created_at) AS newest FROM t_mem GROUP BY scope_id UNION ALL
    SELECT scope_id, max(created_at) FROM t_ccr GROUP BY scope_id) GROUP BY scope_id""")
def last_update(spark, sf):
    return R.last_update(td.memories(spark, sf), td.compressed(spark, sf)).withColumn(
        "last_updated", F.col("last_updated").cast("string"))


_LATEST = """
  SELECT scope_id, CAST(timestamp AS VARCHAR) AS retrieved_at, original_ref, ccr_id FROM (
    SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY timestamp DESC, receipt_id DESC) AS r
    FROM t_rcp WHERE operation = 'retrieve_original' AND NOT failed) WHERE r = 1"""


@query("latest_retrieve", _LATEST)
def latest_retrieve(spark, sf):
    return R.latest_retrieve(td.receipts(spark, sf)).withColumn(
        "retrieved_at", F.col("retrieved_at").cast("string"))


@query("retrieval_trust", f"""
  SELECT coalesce(s.scope_id, d.scope_id) AS scope_id, coalesce(originals_stored, 0) AS originals_stored,
    coalesce(originals_retrieved, 0) AS originals_retrieved, l.original_ref, l.ccr_id
  FROM (SELECT scope_id, count(*) AS originals_stored FROM t_orig GROUP BY scope_id) s
  FULL JOIN (SELECT scope_id, count(DISTINCT original_ref) AS originals_retrieved FROM t_rcp
    WHERE operation = 'retrieve_original' AND NOT failed GROUP BY scope_id) d ON s.scope_id = d.scope_id
  LEFT JOIN ({_LATEST}) l ON l.scope_id = coalesce(s.scope_id, d.scope_id)""")
def retrieval_trust(spark, sf):
    return R.retrieval_trust(td.receipts(spark, sf), td.originals(spark, sf)).drop("retrieved_at")


@query("suggested_action", """
  WITH u AS (SELECT scope_id, count_if(operation = 'compress') AS c, count_if(operation = 'remember') AS s,
      count_if(operation = 'recall') AS r, count_if(operation = 'retrieve_original') AS t
    FROM t_rcp GROUP BY scope_id),
  o AS (SELECT scope_id, count(*) AS n FROM t_orig GROUP BY scope_id)
  SELECT u.scope_id, CASE WHEN c > 0 AND s = 0 THEN 'remember' WHEN c > 0 AND s > 0 AND r = 0 THEN 'recall'
    WHEN t = 0 AND coalesce(n, 0) > 0 THEN 'retrieve' WHEN c > 5 THEN 'stats' ELSE 'compress' END AS action
  FROM u LEFT JOIN o ON u.scope_id = o.scope_id""")
def suggested_action(spark, sf):
    return R.suggested_action(td.receipts(spark, sf), td.originals(spark, sf))


@query("event_value_percentiles", """
  SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50,
    percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, max(value) AS max, count(value) AS runs
  FROM events GROUP BY event_type""")
def event_value_percentiles(spark, sf):
    return nearest_rank(td.table(spark, sf, "events"), ["event_type"], "value", [50, 95])


@query("top_savings", """
  SELECT scope_id, ccr_id, content_type, tokens_saved, compression_ratio, rank FROM (SELECT *,
    row_number() OVER (PARTITION BY scope_id ORDER BY tokens_saved DESC, ccr_id) AS rank FROM t_ccr WHERE NOT failed)
  WHERE rank <= 5""")
def top_savings(spark, sf):
    return R.top_savings(td.compressed(spark, sf)).select(
        "scope_id", "ccr_id", "content_type", "tokens_saved", "compression_ratio",
        F.col("rank").cast("bigint").alias("rank"))


@query("recent_memories", """
  SELECT scope_id, memory_id, type, summary, rank FROM (SELECT *,
    row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC, memory_id) AS rank FROM t_mem WHERE status = 'active')
  WHERE rank <= 10""")
def recent_memories(spark, sf):
    return R.recent_memories(td.memories(spark, sf)).select(
        "scope_id", "memory_id", "type", "summary", F.col("rank").cast("bigint").alias("rank"))


@query("important_memories", """
  SELECT scope_id, memory_id, type, confidence, coalesce(summary, left(content, 80)) AS summary, rank FROM (SELECT *,
    row_number() OVER (PARTITION BY scope_id ORDER BY confidence DESC, memory_id) AS rank FROM t_mem WHERE status = 'active')
  WHERE rank <= 5""")
def important_memories(spark, sf):
    return R.important_memories(td.memories(spark, sf)).select(
        "scope_id", "memory_id", "type", "confidence", "summary", F.col("rank").cast("bigint").alias("rank"))
