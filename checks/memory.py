"""Queries over request validation and memory maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import normalize_sql, query, trim_sql
from corpusmill.operators import memory as M
from corpusmill.operators import validate as V
from corpusmill.sources import testdata as td

_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def _remember_requests(spark, sf):
    """One raw request per document, some of them wrong."""
    d = F.col("doc_id")
    return td.table(spark, sf, "documents").select(
        d.alias("request_id"), F.col("source").alias("scope_id"),
        F.when(d % 11 == 0, "rumour").when(d % 13 == 0, " ").otherwise("decision").alias("type"),
        F.when(d % 17 == 0, "\n ").when(d % 199 == 5, F.repeat("text", 1000)).otherwise(F.col("text")).alias("content"),
        ((d % 14).cast("double") / 10 - 0.1).alias("confidence"),
        F.when(d % 7 == 0, "2027-06-10T00:00:00Z").when(d % 7 == 1, "2027-06-10").when(d % 7 == 2, "soon")
        .alias("expires_at"),
        F.when(d % 5 == 0, "static").when(d % 5 == 1, "sideways").alias("profile_target"),
        F.when(d % 3 == 0, "file:a").when(d % 3 == 1, "note").alias("source_ref"))


@query("validate_remember", f"""
  WITH r AS (SELECT doc_id AS request_id,
      CASE WHEN doc_id % 11 = 0 THEN 'rumour' WHEN doc_id % 13 = 0 THEN ' ' ELSE 'decision' END AS type,
      CASE WHEN doc_id % 17 = 0 THEN chr(10) || ' ' WHEN doc_id % 199 = 5 THEN repeat(text, 1000) ELSE text END AS content,
      (doc_id % 14)::DOUBLE / 10 - 0.1::DOUBLE AS confidence, doc_id % 7 AS x, doc_id % 5 AS p, doc_id % 3 AS s FROM documents)
  SELECT request_id, concat_ws(',',
      CASE WHEN {trim_sql('type')} = '' THEN 'type_required' END, CASE WHEN type = 'rumour' THEN 'type_invalid' END,
      CASE WHEN {trim_sql('content')} = '' THEN 'content_required' END, CASE WHEN length(content) > 256000 THEN 'content_too_long' END,
      CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence_out_of_range' END,
      CASE WHEN x IN (1, 2) THEN 'expires_at_invalid' END, CASE WHEN p = 1 THEN 'profile_target_invalid' END) AS errors,
    CASE WHEN s = 1 THEN 'source_ref_unrecognized' ELSE '' END AS warnings FROM r""")
def validate_remember(spark, sf):
    rows = V.validate_remember(_remember_requests(spark, sf))
    return rows.select("request_id", F.array_join("errors", ",").alias("errors"),
                       F.array_join("warnings", ",").alias("warnings"))


@query("validate_recall", f"""
  WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN '  ' WHEN event_id % 9 = 1 THEN repeat('q', 1001) ELSE 'find ' || event_id END AS query,
      CASE WHEN event_id % 4 = 0 THEN ['bug'] WHEN event_id % 4 = 1 THEN ['bug', 'gossip'] END AS types,
      CASE WHEN event_id % 6 = 0 THEN ['gone'] WHEN event_id % 6 = 1 THEN ['active', 'expired'] END AS statuses,
      event_id % 70 - 2 AS n, event_id % 5 = 0 AS inactive FROM events)
  SELECT id, concat_ws(',', CASE WHEN {trim_sql('query')} = '' THEN 'query_required' END,
      CASE WHEN length(query) > 1000 THEN 'query_too_long' END, CASE WHEN id % 4 = 1 THEN 'types_invalid' END,
      CASE WHEN id % 6 = 0 THEN 'status_invalid' END, CASE WHEN n < 1 THEN 'limit_invalid' END) AS errors,
    CASE WHEN n > 50 THEN 'limit_large' ELSE '' END AS warnings, CAST(n AS INTEGER) AS effective_limit,
    CASE WHEN statuses IS NOT NULL THEN array_to_string(statuses, ',') WHEN inactive THEN 'active,superseded,forgotten,expired'
      ELSE 'active' END AS effective_statuses FROM r""")
def validate_recall(spark, sf):
    e = F.col("event_id")
    requests = td.table(spark, sf, "events").select(
        e.alias("id"),
        F.when(e % 9 == 0, "  ").when(e % 9 == 1, "q" * 1001).otherwise(F.concat(F.lit("find "), e)).alias("query"),
        F.when(e % 4 == 0, F.array(F.lit("bug"))).when(e % 4 == 1, F.array(F.lit("bug"), F.lit("gossip"))).alias("types"),
        F.when(e % 6 == 0, F.array(F.lit("gone"))).when(e % 6 == 1, F.array(F.lit("active"), F.lit("expired")))
        .alias("statuses"),
        (e % 70 - 2).cast("double").alias("limit"), (e % 5 == 0).alias("include_inactive"))
    rows = V.validate_recall(requests)
    return rows.select("id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "effective_limit",
                       F.array_join("effective_statuses", ",").alias("effective_statuses"))


_MODES = "['soft_forget','supersede','expire','hard_delete','forgive','']"


@query("validate_forget", f"""
  WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN '' ELSE 'mem_1' END AS memory_id,
      ({_MODES})[event_id % 6 + 1] AS mode, CASE WHEN event_id % 8 = 0 THEN repeat('r', 2001) ELSE 'r' END AS reason,
      CASE WHEN event_id % 4 = 1 THEN 'mem_2' END AS superseded_by FROM events)
  SELECT id, concat_ws(',', CASE WHEN memory_id = '' THEN 'id_required' END, CASE WHEN mode = '' THEN 'mode_required' END,
      CASE WHEN mode = 'forgive' THEN 'mode_invalid' END, CASE WHEN length(reason) > 2000 THEN 'reason_too_long' END,
      CASE WHEN mode = 'supersede' AND superseded_by IS NULL THEN 'superseded_by_required' END) AS errors FROM r""")
def validate_forget(spark, sf):
    e = F.col("event_id")
    modes = F.array(*[F.lit(m) for m in ("soft_forget", "supersede", "expire", "hard_delete", "forgive", "")])
    requests = td.table(spark, sf, "events").select(
        e.alias("id"), F.when(e % 10 == 0, "").otherwise("mem_1").alias("memory_id"),
        F.element_at(modes, (e % 6 + 1).cast("int")).alias("mode"),
        F.when(e % 8 == 0, "r" * 2001).otherwise("r").alias("reason"),
        F.when(e % 4 == 1, "mem_2").alias("superseded_by"))
    return V.validate_forget(requests).select("id", F.array_join("errors", ",").alias("errors"))


#: The requests of each scope, played one by one: ``live`` holds the active memories, ``ev`` what the request came to.
_REMEMBER = f"""
  WITH RECURSIVE q AS (SELECT doc_id AS id, source AS scope_id, CASE WHEN doc_id % 4 = 0 THEN 'project_rule' ELSE
        (['decision','bug','command','file_summary','project_rule','user_preference','current_task','test_failure','api_contract','dependency'])[doc_id % 10 + 1] END AS type,
      text AS content, CASE WHEN doc_id % 5 = 0 THEN 'static' END AS layer,
      CASE WHEN doc_id % 3 = 0 THEN 'mem_' || (doc_id - doc_id % 100 + doc_id % 20) END AS target FROM documents),
  f AS (SELECT *, sha256(scope_id || '|' || type || '|' || {normalize_sql('content')}) AS fp FROM q),
  o AS (SELECT *, 'mem_' || sha256(fp || '|' || id) AS new_id, row_number() OVER (PARTITION BY scope_id ORDER BY id) AS n FROM f),
  start AS (SELECT scope_id, list({{'fp': coalesce(fingerprint, ''), 'id': memory_id}}) FILTER (status = 'active') AS live FROM t_mem GROUP BY scope_id),
  play AS (SELECT s.scope_id, 0 AS n, coalesce(live, []) AS live, NULL::BIGINT AS id, NULL::VARCHAR AS action, NULL::VARCHAR AS memory_id, NULL::VARCHAR AS reason
      FROM (SELECT DISTINCT scope_id FROM o) s LEFT JOIN start USING (scope_id)
    UNION ALL SELECT scope_id, n, CASE action WHEN 'created' THEN list_append(live, {{'fp': fp, 'id': new_id}})
        WHEN 'replaced' THEN list_append(list_filter(live, lambda x: x.id != target), {{'fp': fp, 'id': new_id}}) ELSE live END, id, action,
        CASE action WHEN 'deduplicated' THEN known WHEN 'rejected' THEN NULL ELSE new_id END,
        CASE WHEN action = 'rejected' THEN CASE WHEN EXISTS (SELECT 1 FROM t_mem m WHERE m.scope_id = z.scope_id AND m.memory_id = z.target)
          THEN 'superseded_memory_not_active' ELSE 'superseded_memory_not_found' END END
      FROM (SELECT o.*, p.live, list_min(list_transform(list_filter(p.live, lambda x: x.fp = o.fp), lambda x: x.id)) AS known,
          CASE WHEN len(list_filter(p.live, lambda x: x.fp = o.fp)) > 0 THEN 'deduplicated' WHEN o.target IS NULL THEN 'created'
            WHEN len(list_filter(p.live, lambda x: x.id = o.target)) > 0 THEN 'replaced' ELSE 'rejected' END AS action
        FROM play p JOIN o ON o.scope_id = p.scope_id AND o.n = p.n + 1) z),
  y AS (SELECT p.action, p.memory_id, p.reason, o.* FROM play p JOIN o USING (scope_id, id))
"""


def _changes(spark, sf):
    """Every document asked to be remembered, whole; a third replace a memory, a fifth are facts of a profile."""
    d = F.col("doc_id")
    rule = F.when(d % 4 == 0, "project_rule").otherwise(
        F.element_at(F.array(*[F.lit(t) for t in td.MEMORY_TYPES]), (d % 10 + 1).cast("int")))
    return td.table(spark, sf, "documents").select(
        d.alias("request_id"), F.col("source").alias("scope_id"), rule.alias("type"), F.col("text").alias("content"),
        F.when(d % 5 == 0, "static").alias("profile_target"),
        F.when(d % 3 == 0, F.concat(F.lit("mem_"), d - d % 100 + d % 20)).alias("supersedes_memory_id"))


def _remembered(spark, sf):
    return M.remember(td.memories(spark, sf), _changes(spark, sf), td.NOW)


@query("remember_outcomes", _REMEMBER + " SELECT id AS request_id, action, memory_id, reason FROM y")
def remember_outcomes(spark, sf):
    change = _remembered(spark, sf)
    done = change.outcomes.select("request_id", "action", "memory_id", F.lit(None).cast("string").alias("reason"))
    bad = change.rejects.select("request_id", F.lit("rejected").alias("action"),
                                F.lit(None).cast("string").alias("memory_id"), "reason")
    return done.unionByName(bad)


@query("remembered_table", _REMEMBER + """
  SELECT m.memory_id, CASE WHEN y.id IS NOT NULL THEN 'superseded' ELSE m.status END AS status,
    CASE WHEN y.id IS NOT NULL THEN y.new_id ELSE m.superseded_by END AS superseded_by,
    m.confidence FROM t_mem m LEFT JOIN y ON m.scope_id = y.scope_id AND m.memory_id = y.target AND y.action = 'replaced'
  UNION ALL SELECT new_id, 'active', NULL, 0.8::DOUBLE FROM y WHERE action IN ('created', 'replaced')""")
def remembered_table(spark, sf):
    return _remembered(spark, sf).table.select("memory_id", "status", "superseded_by", "confidence")


@query("remember_facts", _REMEMBER + """
  SELECT 'pf_' || sha256(new_id) AS fact_id, scope_id, layer, content, new_id AS source_memory_id FROM y WHERE action IN ('created', 'replaced') AND layer IS NOT NULL""")
def remember_facts(spark, sf):
    return _remembered(spark, sf).facts.select("fact_id", "scope_id", "layer", "content", "source_memory_id")


@query("remember_receipts", _REMEMBER + """
  SELECT 'rcp_' || sha256('remember|' || scope_id || '|' || id) AS receipt_id, scope_id,
    memory_id || CASE WHEN action = 'replaced' THEN ',' || target ELSE '' END AS memory_ids FROM y WHERE action != 'rejected'""")
def remember_receipts(spark, sf):
    return _remembered(spark, sf).receipts.select("receipt_id", "scope_id", F.array_join("memory_ids", ",").alias("memory_ids"))


def _forget_requests(spark, sf):
    e = F.col("event_id")
    modes = F.array(*[F.lit(m) for m in ("soft_forget", "supersede", "expire", "hard_delete")])
    return td.table(spark, sf, "events").select(
        e.alias("request_id"), F.concat(F.lit("src"), (e * 7 % 1000) % 20).alias("scope_id"),
        F.concat(F.lit("mem_"), e * 7 % 1000).alias("memory_id"),
        F.element_at(modes, (e % 4 + 1).cast("int")).alias("mode"), F.lit("stale").alias("reason"),
        F.when(e % 4 == 1, "mem_0").alias("superseded_by"))


_FORGET = """
  WITH q AS (SELECT event_id AS id, 'src' || (event_id * 7 % 1000 % 20) AS scope_id, 'mem_' || (event_id * 7 % 1000) AS memory_id,
      (['soft_forget','supersede','expire','hard_delete'])[event_id % 4 + 1] AS mode,
      (['forgotten','superseded','expired',NULL])[event_id % 4 + 1] AS to_status,
      CASE WHEN event_id % 4 = 1 THEN 'mem_0' END AS successor FROM events),
  j AS (SELECT q.*, m.status AS before FROM q LEFT JOIN t_mem m ON q.scope_id = m.scope_id AND q.memory_id = m.memory_id),
  k AS (SELECT *, CASE WHEN before IS NULL THEN 'memory_not_found' WHEN mode = 'hard_delete' THEN NULL
      WHEN before != 'active' THEN 'invalid_transition' END AS reject FROM j),
  f AS (SELECT scope_id, memory_id, min(id) AS first FROM k WHERE reject IS NULL GROUP BY ALL),
  z AS (SELECT k.*, CASE WHEN reject IS NULL AND id != first THEN 'already_handled' ELSE reject END AS why
    FROM k LEFT JOIN f ON k.scope_id = f.scope_id AND k.memory_id = f.memory_id)
"""


@query("forget_outcomes", _FORGET + """
  SELECT id AS request_id, mode, before AS previous_status, to_status AS new_status,
    CASE WHEN mode = 'hard_delete' THEN (SELECT count(*) FROM t_fact p WHERE p.scope_id = z.scope_id AND p.source_memory_id = z.memory_id) END AS facts_deleted,
    NULL::VARCHAR AS reject FROM z WHERE why IS NULL
  UNION ALL SELECT id, mode, NULL, NULL, NULL, why FROM z WHERE why IS NOT NULL""")
def forget_outcomes(spark, sf):
    change, _ = M.forget(td.memories(spark, sf), td.profile_facts(spark, sf), _forget_requests(spark, sf), td.NOW)
    done = change.outcomes.select("request_id", "mode", "previous_status", "new_status", "facts_deleted",
                                  F.lit(None).cast("string").alias("reject"))
    bad = change.rejects.select("request_id", "mode", F.col("reason").alias("reject"))
    return done.unionByName(bad, allowMissingColumns=True)


@query("forgotten_table", _FORGET + """
  SELECT m.memory_id, coalesce(z.to_status, m.status) AS status, coalesce(z.successor, m.superseded_by) AS superseded_by
  FROM t_mem m LEFT JOIN z ON m.scope_id = z.scope_id AND m.memory_id = z.memory_id AND z.why IS NULL
  WHERE coalesce(z.mode, '') != 'hard_delete'""")
def forgotten_table(spark, sf):
    change, _ = M.forget(td.memories(spark, sf), td.profile_facts(spark, sf), _forget_requests(spark, sf), td.NOW)
    return change.table.select("memory_id", "status", "superseded_by")


@query("facts_after_forget", _FORGET + """
  SELECT fact_id FROM t_fact p WHERE NOT EXISTS (SELECT 1 FROM z WHERE why IS NULL AND mode = 'hard_delete'
    AND z.scope_id = p.scope_id AND z.memory_id = p.source_memory_id)""")
def facts_after_forget(spark, sf):
    _, facts = M.forget(td.memories(spark, sf), td.profile_facts(spark, sf), _forget_requests(spark, sf), td.NOW)
    return facts.select("fact_id")


@query("wrong_memory_events", _FORGET + """
  SELECT 'fev_' || sha256('recall_wrong_memory|' || scope_id || '|' || memory_id) AS failure_id, memory_id, 'forgotten_via_' || mode AS error_reason
  FROM z WHERE why IS NULL""")
def wrong_memory_events(spark, sf):
    change, _ = M.forget(td.memories(spark, sf), td.profile_facts(spark, sf), _forget_requests(spark, sf), td.NOW)
    return M.wrong_memory_events(change.outcomes, td.NOW).select("failure_id", "memory_id", "error_reason")


@query("expire_memories", f"""
  SELECT memory_id, CASE WHEN status = 'active' AND expires_at < {_NOW} THEN 'expired' ELSE status END AS status FROM t_mem""")
def expire_memories(spark, sf):
    return M.expire_memories(td.memories(spark, sf), td.NOW).select("memory_id", "status")


def _updates(spark, sf):
    d = F.col("doc_id")
    return td.table(spark, sf, "documents").select(
        F.col("source").alias("scope_id"), F.concat(F.lit("mem_"), d + (d % 10 == 4).cast("int") * 10_000_000).alias("memory_id"),
        F.when(d % 3 == 0, "forgotten").otherwise("active").alias("new_status"),
        F.when(d % 4 == 0, F.concat(F.lit("sum "), d)).alias("summary"),
        F.when(d % 6 == 0, 0.25).alias("confidence"))


_UPDATES = """
  WITH u AS (SELECT doc_id, source AS scope_id, 'mem_' || (doc_id + CASE WHEN doc_id % 10 = 4 THEN 10000000 ELSE 0 END) AS memory_id,
      CASE WHEN doc_id % 3 = 0 THEN 'forgotten' ELSE 'active' END AS new_status,
      CASE WHEN doc_id % 4 = 0 THEN 'sum ' || doc_id END AS new_summary, CASE WHEN doc_id % 6 = 0 THEN 0.25::DOUBLE END AS new_confidence
    FROM documents),
  j AS (SELECT u.*, m.status, CASE WHEN m.status IS NULL THEN 'memory_not_found'
      WHEN (m.status = 'active') = (new_status = 'active') THEN 'invalid_transition' END AS reason
    FROM u LEFT JOIN t_mem m ON u.scope_id = m.scope_id AND u.memory_id = m.memory_id)
"""


@query("update_memories", _UPDATES + """
  SELECT m.memory_id, coalesce(j.new_status, m.status) AS status, coalesce(new_summary, summary) AS summary,
    coalesce(new_confidence, confidence) AS confidence
  FROM t_mem m LEFT JOIN j ON m.memory_id = j.memory_id AND m.scope_id = j.scope_id AND j.reason IS NULL""")
def update_memories(spark, sf):
    change = M.update_memories(td.memories(spark, sf), _updates(spark, sf), td.NOW)
    return change.table.select("memory_id", "status", "summary", "confidence")


@query("rejected_updates", _UPDATES + "SELECT memory_id, reason FROM j WHERE reason IS NOT NULL")
def rejected_updates(spark, sf):
    change = M.update_memories(td.memories(spark, sf), _updates(spark, sf), td.NOW)
    return change.rejects.select("memory_id", "reason")


def _fact_changes(spark, sf):
    d = F.col("doc_id")
    return td.table(spark, sf, "documents").select(
        F.col("source").alias("scope_id"), F.concat(F.lit("pf_"), d).alias("fact_id"),
        F.when(d % 3 == 0, "update").when(d % 3 == 1, "expire").otherwise("delete").alias("action"),
        F.when(d % 4 < 2, "static").otherwise("dynamic").alias("expected_layer"),
        F.concat(F.lit("new "), d).alias("content"), F.lit(None).cast("double").alias("confidence"))


_FACTS = """
  WITH c AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'expire' ELSE 'delete' END AS action,
      CASE WHEN doc_id % 4 < 2 THEN 'static' ELSE 'dynamic' END AS expected FROM t_fact),
  j AS (SELECT *, action != 'delete' AND layer != expected AS bad FROM c)
"""


@query("update_facts", _FACTS + f"""
  SELECT fact_id, CASE WHEN action = 'update' AND NOT bad THEN 'new ' || doc_id ELSE content END AS content,
    CAST(CASE WHEN action = 'expire' AND NOT bad THEN {_NOW} ELSE expires_at END AS VARCHAR) AS expires_at, confidence
  FROM j WHERE bad OR action != 'delete'""")
def update_facts(spark, sf):
    change = M.update_facts(td.profile_facts(spark, sf), _fact_changes(spark, sf), td.NOW)
    return change.table.select("fact_id", "content", F.col("expires_at").cast("string").alias("expires_at"), "confidence")


@query("rejected_fact_changes", _FACTS + "SELECT fact_id, action, 'layer_mismatch' AS reason FROM j WHERE bad")
def rejected_fact_changes(spark, sf):
    change = M.update_facts(td.profile_facts(spark, sf), _fact_changes(spark, sf), td.NOW)
    return change.rejects.select("fact_id", "action", "reason")


@query("backfill_fingerprints", f"""
  SELECT memory_id, coalesce(fingerprint, sha256(scope_id || '|' || type || '|' || {normalize_sql('content')})) AS fingerprint FROM t_mem""")
def backfill_fingerprints(spark, sf):
    return M.backfill_fingerprints(td.memories(spark, sf)).select("memory_id", "fingerprint")


@query("backfill_counts", """
  SELECT count_if(fingerprint IS NULL) AS eligible_rows, count_if(fingerprint IS NULL) AS backfilled_rows,
    count_if(fingerprint IS NOT NULL) AS preserved_rows FROM t_mem""")
def backfill_counts(spark, sf):
    return M.backfill_counts(td.memories(spark, sf))


@query("derive_references", """
  WITH q AS (SELECT doc_id AS id, source AS scope_id, CASE doc_id % 4 WHEN 0 THEN 'ccr_' || doc_id WHEN 1 THEN 'ccr_x' END AS ccr_id,
      CASE WHEN doc_id % 6 IN (2, 3) THEN 'orig_' || (doc_id * 3) WHEN doc_id % 6 = 4 THEN 'orig_' || doc_id END AS original_ref,
      CASE WHEN doc_id % 10 = 0 THEN ' file:a ' END AS source_ref, CASE WHEN doc_id % 8 = 0 THEN 'own' END AS summary FROM documents)
  SELECT q.id, coalesce(trim(q.source_ref), 'ccr:' || q.ccr_id, 'orig:' || q.original_ref) AS source_ref,
    coalesce(q.summary, c.summary) AS summary,
    CASE WHEN q.ccr_id IS NOT NULL AND c.ccr_id IS NULL THEN 'ccr_not_found' WHEN q.original_ref IS NOT NULL AND o.scope_id IS NULL
      THEN 'original_not_found' WHEN o.scope_id != q.scope_id THEN 'original_in_other_scope' END AS error,
    CASE c.content_type WHEN 'test_output' THEN 'type_should_be_test_failure' WHEN 'file_summary' THEN 'type_should_be_file_summary' END AS warning
  FROM q LEFT JOIN t_ccr c ON q.scope_id = c.scope_id AND q.ccr_id = c.ccr_id LEFT JOIN t_orig o ON q.original_ref = o.original_id""")
def derive_references(spark, sf):
    d = F.col("doc_id")
    requests = td.table(spark, sf, "documents").select(
        d.alias("id"), F.col("source").alias("scope_id"), F.lit("decision").alias("type"),
        F.when(d % 4 == 0, F.concat(F.lit("ccr_"), d)).when(d % 4 == 1, "ccr_x").alias("ccr_id"),
        F.when((d % 6).isin(2, 3), F.concat(F.lit("orig_"), d * 3))
        .when(d % 6 == 4, F.concat(F.lit("orig_"), d)).alias("original_ref"),
        F.when(d % 10 == 0, " file:a ").alias("source_ref"), F.when(d % 8 == 0, "own").alias("summary"))
    done = M.derive_references(requests, td.compressed(spark, sf), td.originals(spark, sf))
    return done.select("id", "source_ref", "summary", "error", "warning")


_EXPIRED = f"""
  WITH d AS (SELECT * FROM t_orig WHERE expires_at <= {_NOW}),
  a AS (SELECT DISTINCT ccr_id FROM d WHERE ccr_id NOT IN (SELECT ccr_id FROM t_orig WHERE expires_at IS NULL OR expires_at > {_NOW}))
"""


@query("expire_originals", _EXPIRED + """
  SELECT 'deleted' AS kind, original_id AS id FROM d UNION ALL SELECT 'affected', ccr_id FROM a
  UNION ALL SELECT 'kept', original_id FROM t_orig WHERE original_id NOT IN (SELECT original_id FROM d)""")
def expire_originals(spark, sf):
    r = M.expire_originals(td.originals(spark, sf), td.compressed(spark, sf), td.NOW)
    parts = [r.deleted.select(F.lit("deleted").alias("kind"), F.col("original_id").alias("id")),
             r.affected.select(F.lit("affected").alias("kind"), F.col("ccr_id").alias("id")),
             r.originals.select(F.lit("kept").alias("kind"), F.col("original_id").alias("id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("flags_after_expiry", _EXPIRED + """
  SELECT ccr_id, can_retrieve_original AND ccr_id NOT IN (SELECT ccr_id FROM a) AS can_retrieve_original FROM t_ccr""")
def flags_after_expiry(spark, sf):
    r = M.expire_originals(td.originals(spark, sf), td.compressed(spark, sf), td.NOW)
    return r.compressed.select("ccr_id", "can_retrieve_original")


@query("delete_scope_originals", """
  SELECT original_id, scope_id FROM t_orig WHERE scope_id NOT IN ('src1', 'src2')""")
def delete_scope_originals(spark, sf):
    r = M.delete_originals(td.originals(spark, sf), td.compressed(spark, sf),
                           F.col("scope_id").isin("src1", "src2"), td.NOW)
    return r.originals.select("original_id", "scope_id")


@query("clear_cache", """
  SELECT 'ccr' AS kind, ccr_id AS id FROM t_ccr WHERE cache_key IS NULL
  UNION ALL SELECT 'orig', original_id FROM t_orig WHERE ccr_id NOT IN (SELECT ccr_id FROM t_ccr WHERE cache_key IS NOT NULL)
  UNION ALL SELECT 'deleted', ccr_id FROM t_ccr WHERE cache_key IS NOT NULL""")
def clear_cache(spark, sf):
    ccr, originals, deleted = M.clear_cache(td.compressed(spark, sf), td.originals(spark, sf))
    return (ccr.select(F.lit("ccr").alias("kind"), F.col("ccr_id").alias("id"))
            .unionByName(originals.select(F.lit("orig").alias("kind"), F.col("original_id").alias("id")))
            .unionByName(deleted.select(F.lit("deleted").alias("kind"), F.col("ccr_id").alias("id"))))


@query("count_retrievals", """
  SELECT c.ccr_id, retrieve_count + coalesce(n, 0) AS retrieve_count FROM t_ccr c LEFT JOIN (
    SELECT ccr_id, count(*) AS n FROM t_rcp WHERE operation = 'retrieve_original' AND NOT failed GROUP BY ccr_id) r ON c.ccr_id = r.ccr_id""")
def count_retrievals(spark, sf):
    done = td.receipts(spark, sf).filter((F.col("operation") == "retrieve_original") & ~F.col("failed"))
    rows = done.select(F.explode("ccr_ids").alias("ccr_id"))
    return M.count_retrievals(td.compressed(spark, sf), rows).select("ccr_id", "retrieve_count")


@query("admit_summaries", """
  WITH q AS (SELECT doc_id AS id, (['log','test_output','unknown','markdown'])[doc_id % 4 + 1] AS t,
      (['VERIFIED','UNVERIFIED','conflicting','maybe',' verified '])[doc_id % 5 + 1] AS v, doc_id % 12 = 0 AS c,
      CASE WHEN doc_id % 7 = 0 THEN 'run the build' ELSE '' END AS goal, doc_id % 3 = 0 AS facts, doc_id % 2 = 0 AS inf,
      doc_id % 11 != 0 AS ok, doc_id % 13 != 0 AS saved, doc_id % 9 != 0 AS orig, text FROM documents),
  s AS (SELECT *, CASE WHEN c OR v = 'conflicting' THEN 'CONTRADICTORY' WHEN upper(trim(v)) IN ('VERIFIED','UNVERIFIED')
      THEN upper(trim(v)) ELSE 'UNKNOWN' END AS st,
      t = 'test_output' OR regexp_matches(goal || chr(10) || text, '(?i)\\b(build|security[ -]?scan|vulnerability|sast|dast|dependency[ -]?audit)\\b') AS sens FROM q)
  SELECT id, CASE WHEN NOT saved THEN 'compressed row was not saved' WHEN NOT ok THEN 'compression failed'
    WHEN t = 'unknown' THEN 'content type is unknown' WHEN st = 'CONTRADICTORY' THEN 'summary is contradictory'
    WHEN st = 'UNKNOWN' THEN 'verification status is unknown'
    WHEN sens AND st != 'VERIFIED' THEN 'verifiable output requires a verified summary'
    WHEN sens AND NOT orig THEN 'verifiable output requires a saved original'
    WHEN sens AND NOT facts THEN 'verifiable output has no verified facts'
    WHEN NOT facts AND NOT inf THEN 'summary has no admissible facts or inferences' END AS reason FROM s""")
def admit_summaries(spark, sf):
    d = F.col("doc_id")

    def pick(*values, n):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (d % n + 1).cast("int"))

    rows = td.table(spark, sf, "documents").select(
        d.alias("id"), pick("log", "test_output", "unknown", "markdown", n=4).alias("content_type"),
        F.col("text").alias("content"), F.when(d % 7 == 0, "run the build").otherwise("").alias("goal"),
        pick("VERIFIED", "UNVERIFIED", "conflicting", "maybe", " verified ", n=5).alias("verification"),
        (d % 12 == 0).alias("contradictory"), F.when(d % 3 == 0, F.array(F.lit("f"))).otherwise(F.array(F.lit(" "))).alias("facts"),
        F.when(d % 2 == 0, F.array(F.lit("i"))).alias("inferences"), (d % 11 != 0).alias("compression_ok"),
        (d % 13 != 0).alias("ccr_saved"), (d % 9 != 0).alias("original_saved"))
    return M.admit_summaries(rows).select("id", "reason")
