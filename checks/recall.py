"""Queries over recall (K1-K12, C7-C9 through K10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, round_sql
from corpusmill.operators import recall as K
from corpusmill.sources import testdata as td

_PRESERVED = r"/?[A-Za-z0-9_$@.][A-Za-z0-9_$@./:\\-]*"


def _distinct_ci(c: str) -> str:
    """First spelling of every term, in order."""
    return (f"list_filter({c}, lambda t_, i_: t_ != '' AND list_position(list_transform({c}, lambda y_: lower(y_)), lower(t_)) = i_)")


_TERMS = """
  q AS (SELECT *, list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x != '') AS terms FROM t_query),
"""
_MATCH = _TERMS + f"""
  p AS (SELECT q.*, list_transform(terms, lambda x: lower(x)) AS lt, m.memory_id, m.type, m.status, m.confidence, m.created_at, m.source_ref,
      lower(m.content) AS c, lower(coalesce(m.summary, '')) AS s FROM q JOIN t_mem m ON q.scope_id = m.scope_id AND m.status = 'active'),
  h AS (SELECT * FROM p WHERE len(list_filter(lt, lambda t: contains(c, t) OR contains(s, t))) > 0),
  r AS (SELECT *, {round_sql('''
      list_reduce(list_transform(lt, lambda t: (ln((length(c) - length(replace(c, t, ''))) / length(t) + 1)
        + ln((length(s) - length(replace(s, t, ''))) / length(t) + 1) * 2.0::DOUBLE) * CASE WHEN length(t) < 3 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END),
        lambda a, b: a + b, 0.0::DOUBLE)
      + CASE WHEN contains(c, array_to_string(lt, ' ')) THEN 3.0::DOUBLE WHEN contains(s, array_to_string(lt, ' ')) THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END
      + least(1.0::DOUBLE, 200::DOUBLE / greatest(1, length(c)))''', 2)} AS score FROM h),
  b AS (SELECT *, score * (0.2::DOUBLE + confidence * 0.8::DOUBLE) AS merged,
      exp(-(greatest(0, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 86400000000.0::DOUBLE) / 60.0::DOUBLE) AS boost FROM r),
  f AS (SELECT *, {round_sql('merged', 4)} AS merged_score, {round_sql('boost', 4)} AS recency_boost,
      {round_sql('merged * (1 + boost * 0.5::DOUBLE)', 4)} AS final_score FROM b),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, memory_id) AS rank FROM f)
"""
_TOP = "WITH " + _MATCH.strip().rstrip(",")
#: Every two words of a benchmark text that stand side by side, as a query.
_PAIRS = """(SELECT item_id * 100000 + i AS query_id, 'src' || (item_id % 20) AS scope_id, ws[i] || ' ' || ws[i + 1] AS query
  FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x != '') AS ws FROM benchmark), unnest(range(1, len(ws))) AS u(i))"""


def pair_queries(spark, sf):
    words = F.filter(F.split("query", r"\s+"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    asked = td.recall_queries(spark, sf).select("query_id", "scope_id", F.posexplode(pairs).alias("i", "query")).filter("query IS NOT NULL")
    return asked.select((F.col("query_id") * 100000 + F.col("i") + 1).alias("query_id"), "scope_id", "query")


@query("query_terms", "WITH " + _TERMS.strip().rstrip(",") + """
  SELECT query_id, array_to_string(terms, '|') AS terms FROM q WHERE len(terms) > 0""")
def query_terms(spark, sf):
    return K.with_terms(td.recall_queries(spark, sf)).select("query_id", F.array_join("terms", "|").alias("terms"))


@query("matched_memories", _TOP + " SELECT query_id, memory_id, score FROM f")
def matched_memories(spark, sf):
    found = K.matches(td.memories(spark, sf), td.recall_queries(spark, sf))
    return found.select("query_id", "memory_id", "score")


@query("matched_all_terms", _TOP.replace("FROM t_query)", f"FROM {_PAIRS})") + """
  SELECT query_id, memory_id, score FROM f WHERE len(list_filter(lt, lambda t: contains(c, t) OR contains(s, t))) = len(lt)""")
def matched_all_terms(spark, sf):
    found = K.matches(td.memories(spark, sf), pair_queries(spark, sf), mode="all")
    return found.select("query_id", "memory_id", "score")


@query("recall_search", _TOP + """
  SELECT query_id, memory_id, score, merged_score, recency_boost, final_score, rank, 'original' AS match_method FROM k WHERE rank <= 10""")
def recall_search(spark, sf):
    hits = K.search(td.memories(spark, sf), td.recall_queries(spark, sf), td.NOW)
    return hits.select("query_id", "memory_id", "score", "merged_score", "recency_boost", "final_score",
                       F.col("rank").cast("bigint").alias("rank"), "match_method")


@query("recall_matched_terms", _TOP + f""",
  n AS (SELECT query_id, memory_id, {_distinct_ci(f"regexp_extract_all(query, '{_PRESERVED}')")} AS named, s || chr(10) || c AS hay FROM k WHERE rank <= 10)
  SELECT query_id, memory_id, array_to_string(list_filter(named, lambda t: contains(hay, lower(t))), '|') AS matched_terms FROM n""")
def recall_matched_terms(spark, sf):
    hits = K.search(td.memories(spark, sf), td.recall_queries(spark, sf), td.NOW)
    return hits.select("query_id", "memory_id", F.array_join("matched_terms", "|").alias("matched_terms"))


@query("recall_by_type", _TOP.replace("AND m.status = 'active'", "AND m.status IN ('active','expired') AND m.type IN ('bug','decision')")
       + " SELECT query_id, memory_id, final_score, rank FROM k WHERE rank <= 3")
def recall_by_type(spark, sf):
    asked = td.recall_queries(spark, sf).withColumns({
        "types": F.array(F.lit("bug"), F.lit("decision")), "statuses": F.array(F.lit("active"), F.lit("expired")),
        "limit": F.lit(3)})
    hits = K.search(td.memories(spark, sf), asked, td.NOW)
    return hits.select("query_id", "memory_id", "final_score", F.col("rank").cast("bigint").alias("rank"))


@query("recall_legacy_scores", _TOP.replace("0.2::DOUBLE + confidence * 0.8::DOUBLE", "0.0::DOUBLE + confidence * 1.0::DOUBLE")
       .replace("/ 60.0::DOUBLE", "/ 30.0::DOUBLE").replace("boost * 0.5::DOUBLE", "boost * 0.3::DOUBLE")
       + " SELECT query_id, memory_id, final_score, rank FROM k WHERE rank <= 5")
def recall_legacy_scores(spark, sf):
    hits = K.search(td.memories(spark, sf), td.recall_queries(spark, sf), td.NOW, K.LEGACY_SCORER, default_limit=5)
    return hits.select("query_id", "memory_id", "final_score", F.col("rank").cast("bigint").alias("rank"))


_PHRASES = ["本地优先", "离线优先", "幂等键", "幂等性", "幂等", "接口路径", "接口"]


@query("expanded_queries", f"""
  WITH q AS (SELECT item_id AS query_id, ({_PHRASES})[item_id % 7 + 1] AS phrase, regexp_extract_all(text, '{_PRESERVED}') AS words FROM benchmark),
  e AS (SELECT *, CASE phrase WHEN '本地优先' THEN ['local-first'] WHEN '离线优先' THEN ['offline-first'] WHEN '幂等键' THEN ['idempotency', 'key']
      WHEN '接口路径' THEN ['API', 'path'] WHEN '接口' THEN ['API', 'endpoint'] ELSE ['idempotency'] END AS english FROM q),
  l AS (SELECT *, list_concat(words, english) AS x, list_concat([phrase], words) AS o FROM e)
  SELECT query_id, array_to_string({_distinct_ci('x')}, ' ') AS expanded_query, array_to_string({_distinct_ci('o')}, ' ') AS original_terms FROM l""")
def expanded_queries(spark, sf):
    n = F.col("item_id")
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (n % 7 + 1).cast("int"))
    asked = td.table(spark, sf, "benchmark").select(
        n.alias("query_id"), F.concat("text", F.lit(" 的"), phrase).alias("query"))
    return K.expand(asked).select("query_id", "expanded_query", F.array_join("original_terms", " ").alias("original_terms"))


@query("recall_expanded", """
  WITH q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS scope_id, '错误' AS cjk FROM benchmark),
  p AS (SELECT query_id, memory_id, lower(content) AS c, lower(coalesce(summary, '')) AS s FROM q JOIN (
      SELECT memory_id, scope_id, CASE WHEN status = 'active' THEN replace(content, 'un', ' error ') END AS content,
        replace(summary, 'un', ' error ') AS summary, status FROM t_mem) m ON q.scope_id = m.scope_id AND status = 'active')
  SELECT query_id, memory_id, 'expanded' AS match_method, 'error' AS matched_terms FROM p WHERE contains(c, 'error') OR contains(s, 'error')""")
def recall_expanded(spark, sf):
    asked = td.recall_queries(spark, sf).withColumn("query", F.lit("错误"))
    changed = td.memories(spark, sf).withColumns({
        c: F.replace(c, F.lit("un"), F.lit(" error ")) for c in ("content", "summary")})
    found = K.matches(changed, asked)
    return found.select("query_id", "memory_id", "match_method", F.array_join("matched_terms", "|").alias("matched_terms"))


_BM25 = """
  WITH d AS (SELECT memory_id, scope_id, regexp_extract_all(lower(concat_ws(' ', summary, content)), '[\\p{L}\\p{N}]+') AS w FROM t_mem WHERE status = 'active'),
  n AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
  q AS (SELECT query_id, scope_id, list_distinct(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS qs FROM """ + _PAIRS + """),
  u AS (SELECT *, unnest(qs) AS word FROM q),
  f AS (SELECT memory_id, scope_id, len, word, count(*) AS tf FROM (SELECT memory_id, scope_id, len(w) AS len, unnest(w) AS word FROM d)
    WHERE word IN (SELECT word FROM u) GROUP BY ALL),
  g AS (SELECT word, greatest(ln((any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)), 0.000001) AS idf FROM f, n GROUP BY word)
"""


@query("bm25_scores", _BM25 + f"""
  SELECT query_id, memory_id, {round_sql('sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)))', 6)} AS score
  FROM u JOIN f ON u.scope_id = f.scope_id AND u.word = f.word JOIN g ON u.word = g.word, n
  GROUP BY query_id, memory_id, len(qs) HAVING count(*) = len(qs)""")
def bm25_scores(spark, sf):
    scores = K.bm25(td.memories(spark, sf), pair_queries(spark, sf))
    from corpusmill.functions.text import round_half_up
    return scores.select("query_id", "memory_id", round_half_up(F.col("score"), 6).alias("score"))


def _hard_queries(spark, sf):
    """Every benchmark text; the odd ones made unfindable."""
    asked = td.recall_queries(spark, sf)
    return asked.withColumn("query", F.when(F.col("query_id") % 2 == 1, F.concat(F.lit("zqx"), "query_id")).otherwise(F.col("query")))


@query("recall_failures", _TOP + """
  SELECT 'fev_' || sha256('recall_no_hit|' || query_id) AS failure_id, 'recall_no_hit' AS event_type, 'no_results_for_query' AS error_reason
  FROM t_query WHERE query_id % 2 = 1 OR query_id NOT IN (SELECT query_id FROM k)
  UNION ALL SELECT 'fev_' || sha256('recall_low_confidence|' || query_id), 'recall_low_confidence', 'all_results_below_confidence_threshold'
  FROM k WHERE rank = 1 AND query_id % 2 = 0 AND final_score < 0.3""")
def recall_failures(spark, sf):
    asked = _hard_queries(spark, sf)
    hits = K.search(td.memories(spark, sf), asked, td.NOW)
    return K.recall_failures(asked, hits, td.NOW).select("failure_id", "event_type", "error_reason")


@query("recall_receipts", _TOP + """
  SELECT 'rcp_' || sha256('recall|' || t.query_id) AS receipt_id, t.scope_id, coalesce(string_agg(memory_id, ',' ORDER BY rank), '') AS memory_ids
  FROM t_query t LEFT JOIN k ON t.query_id = k.query_id AND rank <= 10 AND t.query_id % 2 = 0 GROUP BY t.query_id, t.scope_id""")
def recall_receipts(spark, sf):
    asked = _hard_queries(spark, sf)
    hits = K.search(td.memories(spark, sf), asked, td.NOW)
    return K.recall_receipts(asked, hits, td.NOW).select(
        "receipt_id", "scope_id", F.array_join("memory_ids", ",").alias("memory_ids"))


@query("recall_related", _TOP + """
  , t AS (SELECT DISTINCT query_id, scope_id, source_ref FROM k WHERE rank <= 10)
  SELECT DISTINCT query_id, c.ccr_id, o.tokens AS original_tokens FROM t JOIN t_ccr c ON t.scope_id = c.scope_id AND (
    CASE WHEN t.source_ref LIKE 'ccr:_%' THEN 'ccr:' || c.ccr_id = t.source_ref
      WHEN t.source_ref LIKE 'orig:_%' THEN 'orig:' || c.original_ref = t.source_ref
      ELSE c.source_ref = t.source_ref OR c.original_ref = t.source_ref END)
  LEFT JOIN t_orig o ON c.can_retrieve_original AND o.original_id = c.original_ref AND o.scope_id = c.scope_id""")
def recall_related(spark, sf):
    result = K.recall(td.memories(spark, sf), td.recall_queries(spark, sf), td.profile_facts(spark, sf),
                      td.compressed(spark, sf), td.NOW, originals=td.originals(spark, sf))
    return result.related.select("query_id", "ccr_id", "original_tokens")


@query("recall_profile", """
  SELECT fact_id, layer FROM t_fact WHERE scope_id IN (SELECT scope_id FROM t_query)
    AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-01')""")
def recall_profile(spark, sf):
    result = K.recall(td.memories(spark, sf), td.recall_queries(spark, sf), td.profile_facts(spark, sf),
                      td.compressed(spark, sf), td.NOW)
    return result.profile.select("fact_id", "layer")
