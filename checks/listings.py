"""Queries over listings, retrieval and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from corpusmill.operators import listing as L
from corpusmill.operators import lookup as J
from corpusmill.sources import testdata as td


def _page_sql(table: str, row_id: str, order: str, where: str = "true", keys: str = "scope_id",
              limit: int = 20, offset: int = 0) -> str:
    return f"""
      SELECT {keys}, {row_id}, rank, total FROM (SELECT *,
          row_number() OVER (PARTITION BY {keys} ORDER BY {order}, {row_id}) AS rank,
          count(*) OVER (PARTITION BY {keys}) AS total FROM {table} WHERE {where})
      WHERE rank > {offset} AND rank <= {offset + limit}"""


def _page(df, row_id, keys="scope_id"):
    return df.select(keys, row_id, F.col("rank").cast("bigint").alias("rank"), "total")


@query("scope_isolation", "SELECT scope_id, memory_id FROM t_mem WHERE scope_id = (SELECT 'src3')")
def scope_isolation(spark, sf):
    return L.in_scope(td.memories(spark, sf), "src3").select("scope_id", "memory_id")


@query("list_memories", _page_sql(
    "t_mem", "memory_id", "confidence DESC NULLS LAST",
    "status IN ('active','expired') AND type IN ('decision','bug','dependency','project_rule')", limit=7, offset=3))
def list_memories(spark, sf):
    rows = L.list_memories(
        td.memories(spark, sf), types=["decision", "bug", "dependency", "project_rule"],
        statuses=["active", "expired"], sort_by="confidence", limit=7, offset=3)
    return _page(rows, "memory_id")


@query("list_compressed", _page_sql("t_ccr", "ccr_id", "created_at DESC", "content_type IN ('log','code')", limit=10))
def list_compressed(spark, sf):
    return _page(L.list_compressed(td.compressed(spark, sf), ["log", "code"], limit=10), "ccr_id")


@query("list_receipts", _page_sql("t_rcp", "receipt_id", "timestamp DESC", "operation = 'recall'", offset=5))
def list_receipts(spark, sf):
    return _page(L.list_receipts(td.receipts(spark, sf), ["recall"], offset=5), "receipt_id")


@query("list_run_receipts", _page_sql("t_rcp", "receipt_id", "timestamp", keys="run_id", limit=30))
def list_run_receipts(spark, sf):
    return _page(L.list_run_receipts(td.receipts(spark, sf), limit=30), "receipt_id", "run_id")


@query("list_failures", _page_sql(
    "t_fail", "failure_id", "created_at DESC", "event_type IN ('oversized_input','recall_no_hit') AND operation = 'compress'"))
def list_failures(spark, sf):
    rows = L.list_failures(td.failures(spark, sf), ["oversized_input", "recall_no_hit"], ["compress"])
    return _page(rows, "failure_id")


@query("list_profile_facts", _page_sql(
    "t_fact", "fact_id", "created_at DESC",
    "layer = 'static' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-01')", limit=15))
def list_profile_facts(spark, sf):
    rows = L.list_profile_facts(td.profile_facts(spark, sf), td.NOW, ["static"], limit=15)
    return _page(rows, "fact_id")


@query("list_cache_entries", _page_sql(
    "t_ccr", "ccr_id", "last_accessed_at DESC NULLS LAST, created_at DESC", "cache_key IS NOT NULL", limit=25))
def list_cache_entries(spark, sf):
    return _page(L.list_cache_entries(td.compressed(spark, sf), limit=25), "ccr_id")


@query("retrieve_ranges", """
  SELECT original_id AS original_ref, scope_id, o AS "offset", sha256(substr(content, o + 1, lim)) AS slice_hash,
    length(content) AS total_chars, length(substr(content, o + 1, lim)) AS returned_chars,
    o + length(substr(content, o + 1, lim)) < length(content) AS has_more
  FROM (SELECT *, greatest(0, least((CAST(substr(original_id, 6) AS BIGINT) % 5) * 400 - 200, length(content))) AS o,
      CASE WHEN CAST(substr(original_id, 6) AS BIGINT) % 7 = 0 THEN length(content) ELSE 1000 END AS lim FROM t_orig)""")
def retrieve_ranges(spark, sf):
    originals = td.originals(spark, sf)
    n = F.substring("original_id", 6, 20).cast("bigint")
    requests = originals.select(
        F.col("original_id").alias("original_ref"), "scope_id",
        ((n % 5) * 400 - 200).alias("offset"), F.when(n % 7 != 0, 1000).alias("limit"))
    got = L.retrieve_ranges(requests, originals)
    return got.select("original_ref", "scope_id", F.col("offset").cast("bigint").alias("offset"),
                      F.sha2("slice", 256).alias("slice_hash"), "total_chars", "returned_chars", "has_more")


@query("retrieve_status", """
  WITH r AS (SELECT event_id, 'orig_' || (event_id % 400) AS original_ref, 'src' || (event_id % 20) AS scope_id FROM events),
  o AS (SELECT * FROM t_orig WHERE content_type != 'json')
  SELECT r.event_id, CASE WHEN o.scope_id = r.scope_id THEN 'ok' WHEN o.scope_id IS NOT NULL THEN 'scope_mismatch'
    WHEN NOT c.can_retrieve_original THEN 'original_deleted' ELSE 'original_not_found' END AS status
  FROM r LEFT JOIN o ON r.original_ref = o.original_id LEFT JOIN t_ccr c ON r.original_ref = c.original_ref""")
def retrieve_status(spark, sf):
    e = F.col("event_id")
    requests = td.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("orig_"), e % 400).alias("original_ref"),
        F.concat(F.lit("src"), e % 20).alias("scope_id"))
    kept = td.originals(spark, sf).filter(F.col("content_type") != "json")
    return L.retrieve_status(requests, kept, td.compressed(spark, sf)).select("event_id", "status")


@query("count_memories", "SELECT scope_id, type, status, count(*) AS n FROM t_mem GROUP BY ALL")
def count_memories(spark, sf):
    return L.count_rows(td.memories(spark, sf), ["type", "status"])


@query("count_compressed", "SELECT scope_id, content_type, count(*) AS n FROM t_ccr GROUP BY ALL")
def count_compressed(spark, sf):
    return L.count_rows(td.compressed(spark, sf), ["content_type"])


@query("count_profile_facts", "SELECT scope_id, layer, count(*) AS n FROM t_fact GROUP BY ALL")
def count_profile_facts(spark, sf):
    return L.count_rows(td.profile_facts(spark, sf), ["layer"])


def _top_facts_sql(layer: str, order: str, k: int) -> str:
    return f"""
      SELECT scope_id, fact_id, type, excerpt, rank FROM (SELECT f.scope_id, fact_id, type, left(m.content, 80) AS excerpt,
        row_number() OVER (PARTITION BY f.scope_id ORDER BY {order}, fact_id) AS rank
        FROM t_fact f JOIN t_mem m ON f.source_memory_id = m.memory_id
        WHERE layer = '{layer}' AND status = 'active') WHERE rank <= {k}"""


@query("top_static_facts", _top_facts_sql("static", "m.confidence DESC, m.created_at DESC", 5))
def top_static_facts(spark, sf):
    top = J.top_facts(td.profile_facts(spark, sf), td.memories(spark, sf), "static", 5)
    return top.select("scope_id", "fact_id", "type", "excerpt", F.col("rank").cast("bigint").alias("rank"))


@query("recent_dynamic_facts", _top_facts_sql("dynamic", "m.created_at DESC", 3))
def recent_dynamic_facts(spark, sf):
    top = J.top_facts(td.profile_facts(spark, sf), td.memories(spark, sf), "dynamic", 3)
    return top.select("scope_id", "fact_id", "type", "excerpt", F.col("rank").cast("bigint").alias("rank"))


@query("rule_usage", """
  WITH used AS (SELECT DISTINCT scope_id, receipt_id, timestamp, unnest(memory_ids) AS memory_id
    FROM t_rcp WHERE operation = 'recall')
  SELECT scope_id, memory_id, recall_count, CAST(last_recalled AS VARCHAR) AS last_recalled, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY recall_count DESC, last_recalled DESC NULLS LAST, memory_id) AS rank
    FROM (SELECT m.scope_id, m.memory_id, count(DISTINCT receipt_id) AS recall_count, max(timestamp) AS last_recalled
      FROM t_mem m LEFT JOIN used u ON m.scope_id = u.scope_id AND m.memory_id = u.memory_id
      WHERE type = 'project_rule' AND status = 'active' GROUP BY ALL)) WHERE rank <= 3""")
def rule_usage(spark, sf):
    top = J.rule_usage(td.memories(spark, sf), td.receipts(spark, sf))
    return top.select("scope_id", "memory_id", "recall_count",
                      F.col("last_recalled").cast("string").alias("last_recalled"),
                      F.col("rank").cast("bigint").alias("rank"))


@query("originals_retrieved", """
  SELECT scope_id, count(DISTINCT original_ref) AS originals_retrieved FROM t_rcp
  WHERE operation = 'retrieve_original' AND NOT failed GROUP BY scope_id""")
def originals_retrieved(spark, sf):
    return J.originals_retrieved(td.receipts(spark, sf))


@query("cached_originals", """
  SELECT original_id FROM t_orig WHERE ccr_id IN (SELECT ccr_id FROM t_ccr WHERE cache_key IS NOT NULL)""")
def cached_originals(spark, sf):
    return J.cached_originals(td.originals(spark, sf), td.compressed(spark, sf)).select("original_id")


@query("without_originals", "SELECT ccr_id FROM t_ccr WHERE ccr_id NOT IN (SELECT ccr_id FROM t_orig)")
def without_originals(spark, sf):
    return J.without_originals(td.compressed(spark, sf), td.originals(spark, sf)).select("ccr_id")


_LINKS = """
  SELECT DISTINCT m.scope_id, m.source_ref, c.ccr_id, c.original_ref, c.can_retrieve_original
  FROM (SELECT DISTINCT scope_id, source_ref FROM t_mem) m JOIN t_ccr c ON m.scope_id = c.scope_id AND (
    CASE WHEN m.source_ref LIKE 'ccr:_%' THEN 'ccr:' || c.ccr_id = m.source_ref
      WHEN m.source_ref LIKE 'orig:_%' THEN 'orig:' || c.original_ref = m.source_ref
      ELSE c.source_ref = m.source_ref OR c.original_ref = m.source_ref END)
"""


@query("related_compressed", f"SELECT scope_id, source_ref, ccr_id, can_retrieve_original FROM ({_LINKS})")
def related_compressed(spark, sf):
    return J.related_compressed(td.memories(spark, sf), td.compressed(spark, sf)).select(
        "scope_id", "source_ref", "ccr_id", "can_retrieve_original")


@query("can_expand", f"""
  SELECT memory_id, (scope_id, source_ref) IN (SELECT (scope_id, source_ref) FROM ({_LINKS}) WHERE can_retrieve_original)
    AS can_expand FROM t_mem""")
def can_expand(spark, sf):
    return J.with_can_expand(td.memories(spark, sf), td.compressed(spark, sf)).select("memory_id", "can_expand")


@query("related_with_originals", f"""
  SELECT l.scope_id, l.source_ref, l.ccr_id, sha256(o.content) AS original_hash, o.tokens AS original_tokens
  FROM ({_LINKS}) l LEFT JOIN t_orig o ON l.scope_id = o.scope_id AND l.can_retrieve_original AND l.original_ref = o.original_id""")
def related_with_originals(spark, sf):
    related = J.related_compressed(td.memories(spark, sf), td.compressed(spark, sf))
    return J.with_originals(related, td.originals(spark, sf)).select(
        "scope_id", "source_ref", "ccr_id", F.sha2("original_content", 256).alias("original_hash"),
        "original_tokens")


@query("superseded_pairs", """
  SELECT a.memory_id, b.memory_id AS supersedes_id FROM t_mem a JOIN t_mem b
    ON a.memory_id = b.superseded_by AND a.scope_id = b.scope_id""")
def superseded_pairs(spark, sf):
    return J.superseded_by(td.memories(spark, sf)).select("memory_id", "supersedes_id")


@query("recent_recalls", """
  WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY timestamp DESC, receipt_id) AS n
    FROM t_rcp WHERE operation = 'recall') WHERE n <= 5)
  SELECT r.scope_id, n AS recall_rank, p AS position, m.memory_id, type, CAST(timestamp AS VARCHAR) AS recalled_at
  FROM (SELECT *, unnest(memory_ids[1:2]) AS memory_id, unnest([0, 1]) AS p FROM r) r
  JOIN t_mem m ON r.scope_id = m.scope_id AND r.memory_id = m.memory_id""")
def recent_recalls(spark, sf):
    return J.recent_recalls(td.receipts(spark, sf), td.memories(spark, sf)).select(
        "scope_id", F.col("recall_rank").cast("bigint").alias("recall_rank"),
        F.col("position").cast("int").alias("position"), "memory_id", "type",
        F.col("recalled_at").cast("string").alias("recalled_at"))


@query("status_transitions", """
  WITH v(a, b) AS (VALUES ('active','superseded'),('active','forgotten'),('active','expired'),
    ('superseded','active'),('forgotten','active'),('expired','active'))
  SELECT memory_id, target, v.a IS NOT NULL AS allowed
  FROM (SELECT memory_id, status, (['active','superseded','forgotten','expired'])[doc_id % 4 + 1] AS target FROM t_mem) m
  LEFT JOIN v ON m.status = v.a AND m.target = v.b""")
def status_transitions(spark, sf):
    n = F.substring("memory_id", 5, 20).cast("bigint")
    target = F.element_at(F.array(*[F.lit(s) for s in J.MEMORY_STATUSES]), (n % 4 + 1).cast("int"))
    moves = td.memories(spark, sf).select("memory_id", "status", target.alias("target"))
    allowed = J.transition_table(spark).withColumn("_ok", F.lit(True))
    joined = moves.join(allowed, (F.col("status") == F.col("from_status")) & (F.col("target") == F.col("to_status")), "left")
    return joined.select("memory_id", "target", F.coalesce("_ok", F.lit(False)).alias("allowed"))
