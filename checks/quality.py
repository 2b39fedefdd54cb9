"""Queries over the quality metrics (Q1-Q5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.recall import _TOP
from checks.registry import query
from corpusmill.operators import quality as Q
from corpusmill.operators import recall as K
from corpusmill.plans.gate import judge_compression
from corpusmill.session import written
from corpusmill.sources import testdata as td


def _cases(spark, sf):
    """Every document cut to half its length; its first and last words are the facts."""
    c = F.col("content")
    docs = td.corpus(spark, sf).withColumn("half", F.substring(c, F.lit(1), F.floor(F.length(c) / 2).cast("int")))
    kind = F.when(F.col("doc_id") % 3 == 0, "conversation_history").otherwise("log")
    results = docs.select(
        F.col("doc_id").alias("case_id"), kind.alias("content_type"), F.replace("half", F.lit("e"), F.lit("E")).alias("compressed_content"),
        F.length(c).cast("bigint").alias("tokens_before"), (F.length(c) - F.length("half")).cast("bigint").alias("tokens_saved"),
        F.lit(0.5).alias("compression_ratio"), (F.col("doc_id") % 50 == 0).alias("failed"))
    facts = F.array(F.substring(c, 1, 4), F.substring(c, -9, 9))
    expectations = docs.select(
        F.col("doc_id").alias("case_id"), facts.alias("key_facts"), "content", F.array(F.substring(c, 1, 4)).alias("must_keep"),
        F.array(F.substring(c, -9, 9)).alias("must_not_invent"), F.lit(None).cast("double").alias("min_savings"))
    stored = td.originals(spark, sf).select(
        F.substring("original_id", 6, 20).cast("bigint").alias("case_id"),
        F.when(F.col("content_type") == "json", "lost").otherwise(F.col("content")).alias("content"))
    return results, expectations, stored


_CASES = """
  WITH c AS (SELECT doc_id, text, replace(left(text, CAST(floor(length(text) / 2) AS BIGINT)), 'e', 'E') AS out, doc_id % 3 = 0 AS conv,
      left(text, 4) AS a, right(text, 9) AS z FROM documents),
  k AS (SELECT *, CASE WHEN conv THEN contains(lower(out), lower(a)) ELSE contains(out, a) END::INT
      + CASE WHEN conv THEN contains(lower(out), lower(z)) ELSE contains(out, z) END::INT AS kept FROM c)
"""


@query("key_fact_retention", _CASES + "SELECT doc_id AS case_id, CAST(kept AS INTEGER) AS facts_retained, kept / 2 AS retention_rate FROM k")
def key_fact_retention(spark, sf):
    results, expectations, _ = _cases(spark, sf)
    return Q.key_fact_retention(results, expectations).select("case_id", "facts_retained", "retention_rate")


@query("retention_summary", _CASES + """
  SELECT count(*) AS cases, floor(avg(kept / 2) * 10000 + 0.5::DOUBLE) / 10000 AS avg_retention, 0.5::DOUBLE AS avg_savings FROM k""")
def retention_summary(spark, sf):
    results, expectations, _ = _cases(spark, sf)
    return Q.retention_summary(Q.key_fact_retention(results, expectations))


@query("compression_gate", _CASES + """
  , g AS (SELECT doc_id, contains(lower(out), lower(a)) AS keeps_facts, NOT contains(out, z) AS invents_nothing,
      (length(text) - floor(length(text) / 2)) / length(text) >= CASE WHEN conv THEN 0.5 ELSE 0.1 END AS saves_enough,
      doc_id % 11 != 4 AS recoverable, doc_id % 50 = 0 AS failed FROM c)
  SELECT doc_id AS case_id, keeps_facts, invents_nothing, saves_enough, recoverable,
    NOT failed AND keeps_facts AND invents_nothing AND saves_enough AND recoverable AS passed FROM g""")
def compression_gate(spark, sf):
    return Q.compression_gate(*_cases(spark, sf)).drop("content_type")


_URGENT = "FATAL|ERROR|WARN|EXCEPTION|TRACEBACK"


# Every log goes through the compressor; its first three urgent lines must stand in the result, and a log well over the
# budget must be shorter by a tenth. Logs that fit the budget stay as they are, and fail the gate for it.
@query("judged_logs", f"""
  WITH l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM t_logline
      WHERE regexp_matches(upper(line), '{_URGENT}')),
    n AS (SELECT doc_id, count(*) AS c FROM l WHERE k <= 3 GROUP BY doc_id),
    d AS (SELECT doc_id, ceil((sum(length(line)) + count(*) - 1) / 4) > 400 / 0.9 AS long FROM t_logline GROUP BY doc_id)
  SELECT d.doc_id AS case_id, CAST(coalesce(c, 0) AS INTEGER) AS facts_total, CAST(coalesce(c, 0) AS INTEGER) AS facts_retained,
    true AS keeps_facts, true AS invents_nothing, long AS saves_enough, true AS recoverable, long AS passed
  FROM d LEFT JOIN n ON d.doc_id = n.doc_id""")
def judged_logs(spark, sf):
    logs = td.as_documents(td.log_lines(spark, sf))
    docs = logs.select(F.col("doc_id").alias("case_id"), "content", F.lit("log").alias("content_type"))
    urgent = F.slice(F.filter(F.split("content", "\n"), lambda x: F.upper(x).rlike(_URGENT)), 1, 3)
    expectations = docs.select(
        "case_id", urgent.alias("key_facts"), urgent.alias("must_keep"), F.array(F.lit("\ufffd")).alias("must_not_invent"),
        F.lit(None).cast("double").alias("min_savings"))
    judged = judge_compression(docs, expectations, docs.select("case_id", "content"), max_tokens=400)
    return judged.drop("content_type", "retention_rate", "compression_ratio")


def _probes(spark, sf):
    """Every memory whose id 20 divides asks with its whole text, which is also the target, against all memories."""
    d = F.substring("memory_id", 5, 20).cast("bigint")
    asking = td.memories(spark, sf).filter((F.col("status") == "active") & (d % 20 == 0))
    return asking.select(
        d.alias("query_id"), "scope_id", F.col("content").alias("query"),
        F.when(d % 40 == 0, "precision").otherwise("broad").alias("kind"), F.col("content").alias("target_content"))


def _evaluated(spark, sf):
    memories, probes = td.memories(spark, sf), _probes(spark, sf)
    hits = K.search(memories, probes, td.NOW).select("scope_id", "query_id", "memory_id", "rank")
    return memories, probes, written(hits, "hits")


_PROBES = """(SELECT doc_id AS query_id, scope_id, content AS query, content AS target,
    CASE WHEN doc_id % 40 = 0 THEN 'precision' ELSE 'broad' END AS kind FROM t_mem WHERE status = 'active' AND doc_id % 20 = 0)"""
_RANKS = _TOP.replace("FROM t_query)", f"FROM {_PROBES})") + f""",
  x AS (SELECT k.query_id, min(rank) AS rank_found FROM k JOIN t_mem m ON k.memory_id = m.memory_id
    WHERE rank <= 10 AND contains(m.content, k.target) GROUP BY k.query_id),
  y AS (SELECT p.query_id, p.kind, rank_found, coalesce(rank_found = 1, false) AS in_top_1, coalesce(rank_found <= 3, false) AS in_top_3
    FROM {_PROBES} p LEFT JOIN x ON p.query_id = x.query_id)
"""


@query("recall_ranks", _RANKS + "SELECT query_id, kind, CAST(rank_found AS INTEGER) AS rank_found, in_top_1, in_top_3 FROM y")
def recall_ranks(spark, sf):
    memories, probes, hits = _evaluated(spark, sf)
    return Q.recall_ranks(hits, memories, probes)


@query("recall_rates", _RANKS + """
  SELECT kind, count(*) AS queries, floor(avg(in_top_1::INT) * 10000 + 0.5::DOUBLE) / 10000 AS recall_at_1,
    floor(avg(in_top_3::INT) * 10000 + 0.5::DOUBLE) / 10000 AS recall_at_3, NULL::DOUBLE AS false_recall FROM y GROUP BY kind
  UNION ALL SELECT 'negative', count(*), NULL, NULL, 0.0::DOUBLE FROM y""")
def recall_rates(spark, sf):
    memories, probes, hits = _evaluated(spark, sf)
    nonsense = probes.select(F.col("query_id"), "scope_id", F.concat(F.lit("zqxj"), "query_id").alias("query"))
    missed = K.search(memories, nonsense, td.NOW)
    return Q.recall_rates(Q.recall_ranks(hits, memories, probes), missed, nonsense)


@query("recall_leaks", _RANKS + """
  , hh AS (SELECT k.query_id, k.memory_id, m.scope_id != k.scope_id AS alien, m.status != 'active' AS gone FROM k JOIN t_mem m ON k.memory_id = m.memory_id WHERE rank <= 10)
  SELECT CAST(sum(alien::INT) AS BIGINT) AS cross_scope, CAST(sum(gone::INT) AS BIGINT) AS non_active,
    count(*) - count(DISTINCT query_id || '/' || memory_id) AS duplicates FROM hh""")
def recall_leaks(spark, sf):
    memories, probes, hits = _evaluated(spark, sf)
    return Q.leaks(hits, probes, memories)


@query("quality_verdict", _RANKS + """
  , v AS (SELECT avg(in_top_1::INT) FILTER (kind = 'precision') >= 0.80 AS a, avg(in_top_3::INT) FILTER (kind = 'broad') >= 0.95 AS b FROM y)
  SELECT a AS recall_at_1_pass, b AS recall_at_3_pass, true AS no_cross_scope, true AS no_non_active, true AS no_duplicates, a AND b AS passed FROM v""")
def quality_verdict(spark, sf):
    memories, probes, hits = _evaluated(spark, sf)
    ranks = Q.recall_ranks(hits, memories, probes)
    rates = ranks.groupBy("kind").agg(F.avg(F.col("in_top_1").cast("double")).alias("recall_at_1"),
                                      F.avg(F.col("in_top_3").cast("double")).alias("recall_at_3"))
    return Q.verdict(rates, Q.leaks(hits, probes, memories))
