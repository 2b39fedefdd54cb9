"""Queries over sources, sinks and identity (A1-A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from corpusmill.functions.values import decode_string_array, decode_string_map
from corpusmill.sources import store
from corpusmill.sources import testdata as td

_DIRS = """
  SELECT *, CASE WHEN git_root IS NOT NULL AND remote IS NOT NULL THEN 'repo_' || left(sha256(remote || git_root), 8)
      WHEN git_root IS NOT NULL THEN 'repo_' || left(sha256(git_root), 8)
      ELSE 'cwd_' || left(sha256(cwd), 8) END AS scope_id,
    CASE WHEN git_root IS NOT NULL AND remote IS NOT NULL THEN 'gitRemote+gitRoot'
      WHEN git_root IS NOT NULL THEN 'gitRootOnly' ELSE 'cwdFallback' END AS scope_strategy
  FROM t_dir
"""


@query("resolve_scopes", f"SELECT cwd, scope_id, scope_strategy FROM ({_DIRS})")
def resolve_scopes(spark, sf):
    dirs = td.working_directories(spark, sf)
    return store.resolve_scopes(dirs).select("cwd", "scope_id", "scope_strategy")


@query("new_scopes", f"""
  SELECT scope_id, min(cwd) AS cwd FROM ({_DIRS})
  WHERE scope_id NOT IN (SELECT scope_id FROM ({_DIRS}) WHERE scope_strategy = 'gitRootOnly')
  GROUP BY scope_id""")
def new_scopes(spark, sf):
    resolved = store.resolve_scopes(td.working_directories(spark, sf))
    known = resolved.filter(F.col("scope_strategy") == "gitRootOnly")
    return store.new_scopes(known, resolved, td.NOW).select("scope_id", "cwd")


@query("corpus_scan", "SELECT doc_id, source AS scope_id, length(text) AS chars, octet_length(encode(text)) AS bytes FROM documents")
def corpus_scan(spark, sf):
    docs = store.read_corpus(spark, f"{sf}/documents.parquet")
    return docs.select("doc_id", F.col("source").alias("scope_id"),
                       F.length("text").cast("bigint").alias("chars"),
                       F.octet_length("text").cast("bigint").alias("bytes"))


@query("append_compressed", """
  SELECT ccr_id, scope_id, tokens_saved, true AS can_retrieve_original, 0::BIGINT AS retrieve_count,
    false AS failed, 0::BIGINT AS cache_hit_count FROM t_ccr""")
def append_compressed(spark, sf):
    rows = td.compressed(spark, sf).select(
        "ccr_id", "scope_id", "content_type", "compressed_content", "tokens_before",
        "tokens_after", "tokens_saved")
    return store.new_compressed(rows, td.NOW).select(
        "ccr_id", "scope_id", "tokens_saved", "can_retrieve_original", "retrieve_count", "failed",
        "cache_hit_count")


@query("append_originals", """
  SELECT 'orig_' || left(content_hash, 16) AS original_id, min(scope_id) AS scope_id,
    content_hash, any_value(tokens) AS tokens
  FROM t_orig WHERE content_hash NOT IN (SELECT content_hash FROM t_orig WHERE content_type = 'log')
  GROUP BY content_hash""")
def append_originals(spark, sf):
    rows = td.originals(spark, sf).withColumn(
        "original_id", F.concat(F.lit("orig_"), F.substring("content_hash", 1, 16)))
    known = rows.filter(F.col("content_type") == "log")
    return store.new_originals(rows, known, td.NOW).select(
        "original_id", "scope_id", "content_hash", "tokens")


@query("flag_retrievable", """
  SELECT ccr_id, can_retrieve_original OR ccr_id IN (SELECT ccr_id FROM t_orig) AS can_retrieve_original
  FROM t_ccr""")
def flag_retrievable(spark, sf):
    flagged = store.flag_retrievable(td.compressed(spark, sf), td.originals(spark, sf))
    return flagged.select("ccr_id", "can_retrieve_original")


@query("append_receipts", """
  SELECT 'rcp_' || sha256('recall|' || query_id) AS receipt_id, 'recall' AS operation, scope_id, query,
    false AS failed, false AS cache_hit FROM t_query""")
def append_receipts(spark, sf):
    rows = td.recall_queries(spark, sf)
    return store.new_receipts(rows, "recall", td.NOW, ["query_id"]).select(
        "receipt_id", "operation", "scope_id", "query", "failed", "cache_hit")


@query("append_failures", """
  SELECT 'fev_' || sha256('poor_compression_ratio|' || ccr_id) AS failure_id, scope_id, 'compress' AS operation,
    'poor_compression_ratio' AS event_type, ccr_id FROM t_ccr WHERE compression_ratio < 0.05 AND NOT failed""")
def append_failures(spark, sf):
    poor = td.compressed(spark, sf).filter((F.col("compression_ratio") < 0.05) & ~F.col("failed"))
    return store.new_failures(poor, "compress", "poor_compression_ratio", td.NOW, ["ccr_id"]).select(
        "failure_id", "scope_id", "operation", "event_type", "ccr_id")


@query("rejected_failures", """
  WITH e AS (SELECT event_id, CASE WHEN event_id % 7 != 0 THEN 'src' || (user_id % 20) END AS scope_id,
      CASE event_id % 3 WHEN 0 THEN 'recall_no_hit' WHEN 1 THEN event_type END AS kind FROM events)
  SELECT event_id, CASE WHEN scope_id IS NULL THEN 'scope_missing' ELSE 'event_type_unknown' END AS reject_reason
  FROM e WHERE scope_id IS NULL OR kind IS NULL OR kind != 'recall_no_hit'""")
def rejected_failures(spark, sf):
    """Events as failures: those without a scope or of a type that is none."""
    e = F.col("event_id")
    rows = td.table(spark, sf, "events").select(
        "event_id", F.when(e % 7 != 0, F.concat(F.lit("src"), F.col("user_id") % td.SCOPE_COUNT)).alias("scope_id"),
        F.when(e % 3 == 0, "recall_no_hit").when(e % 3 == 1, F.col("event_type")).alias("kind"))
    return store.rejected_failures(rows, F.col("kind")).select("event_id", "reject_reason")


@query("append_profile_facts", """
  SELECT 'pf_' || sha256(memory_id) AS fact_id, scope_id, 'static' AS layer,
    coalesce(summary, content) AS content, memory_id AS source_memory_id, confidence
  FROM t_mem WHERE type = 'project_rule'""")
def append_profile_facts(spark, sf):
    target = F.when(F.col("type") == "project_rule", "static")
    rows = td.memories(spark, sf).withColumn("profile_target", target)
    return store.new_profile_facts(rows, td.NOW).select(
        "fact_id", "scope_id", "layer", "content", "source_memory_id", "confidence")


@query("tolerant_json_columns", """
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS bad_is_null, 2::BIGINT AS tags
  FROM events""")
def tolerant_json_columns(spark, sf):
    props = td.table(spark, sf, "events").select("event_id", "props")
    k = decode_string_map(F.col("props"))["k"].cast("bigint")
    tags = F.concat(F.lit('["a", "'), F.col("event_id"), F.lit('"]'))
    return props.select(
        "event_id", k.alias("k"),
        decode_string_array(F.col("props")).isNull().alias("bad_is_null"),
        F.size(decode_string_array(tags)).cast("bigint").alias("tags"))


@query("link_originals", """
  SELECT c.ccr_id, coalesce(l.original_id, c.original_ref) AS original_ref,
    l.original_id IS NOT NULL OR can_retrieve_original AS can_retrieve_original
  FROM t_ccr c LEFT JOIN (SELECT ccr_id, max(original_id) AS original_id FROM t_orig GROUP BY ccr_id) l
    ON c.ccr_id = l.ccr_id""")
def link_originals(spark, sf):
    links = td.originals(spark, sf).select("ccr_id", "original_id")
    return store.link_originals(td.compressed(spark, sf), links).select(
        "ccr_id", "original_ref", "can_retrieve_original")
