"""Queries over the line table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, tokens_sql, trim_sql
from corpusmill.operators import lines as X
from corpusmill.sources import testdata as td

_PRIORITY = "regexp_matches(upper(line), 'FATAL|ERROR|WARN|EXCEPTION|TRACEBACK')"
_IN_ORDER = "PARTITION BY scope_id, doc_id ORDER BY line_no"


@query("line_table", """
  SELECT scope_id, doc_id, count(*) AS lines, sha256(string_agg(line, '|' ORDER BY line_no)) AS lines_hash FROM (
    SELECT scope_id, doc_id, unnest(ls) AS line, unnest(generate_series(0, len(ls) - 1)) AS line_no
    FROM (SELECT *, string_split(content, chr(10)) AS ls FROM t_corpus)) GROUP BY ALL""")
def line_table(spark, sf):
    rows = X.lines(td.corpus(spark, sf))
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "|")
    return rows.groupBy("scope_id", "doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sha2(joined, 256).alias("lines_hash"))


@query("folded_repeats", f"""
  WITH k AS (SELECT *, regexp_replace(lower({trim_sql("regexp_replace(line, '[0-9]', '', 'g')")}), '\\s+', ' ', 'g') AS key FROM t_logline),
  r AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM key AND n > 0 THEN 0 ELSE 1 END) OVER ({_IN_ORDER}) AS run FROM (
    SELECT *, lag(key) OVER ({_IN_ORDER}) AS p, row_number() OVER ({_IN_ORDER}) - 1 AS n FROM k)),
  g AS (SELECT scope_id, doc_id, run, count(*) AS n, min(line_no) AS start, arg_min(key, line_no) AS first FROM r GROUP BY ALL)
  SELECT scope_id, doc_id, start AS line_no, first AS line FROM g UNION ALL
  SELECT scope_id, doc_id, start + 1, CASE WHEN n > 2 THEN '[↑ Repeated ' || n || ' times — folded to save tokens]' ELSE first END
  FROM g WHERE n >= 2""")
def folded_repeats(spark, sf):
    log = td.log_lines(spark, sf)
    plain = log.withColumn("line", X.section_key(F.regexp_replace("line", "[0-9]", "")))
    return X.fold_repeats(plain)


@query("folded_counts", f"""
  WITH f AS (SELECT *, NOT {_PRIORITY} AND regexp_matches(upper(line), 'INFO|DEBUG') AS info,
      NOT {_PRIORITY} AND regexp_matches(line, '(?i)\\b(heartbeat|ping|keep-?alive|healthcheck)\\b') AS beat FROM t_logline),
  r AS (SELECT *, sum(CASE WHEN info THEN 0 ELSE 1 END) OVER ({_IN_ORDER}) AS ir,
      sum(CASE WHEN beat THEN 0 ELSE 1 END) OVER ({_IN_ORDER}) AS br FROM f),
  i AS (SELECT scope_id, doc_id, greatest(count(*) - 3, 0) AS x, 0 AS y FROM r WHERE info GROUP BY scope_id, doc_id, ir),
  b AS (SELECT scope_id, doc_id, 0 AS x, greatest(count(*) - 2, 0) AS y FROM r WHERE beat GROUP BY scope_id, doc_id, br)
  SELECT scope_id, doc_id, CAST(sum(x) AS BIGINT) AS folded_info, CAST(sum(y) AS BIGINT) AS folded_heartbeats
  FROM (SELECT * FROM i UNION ALL SELECT * FROM b) GROUP BY scope_id, doc_id""")
def folded_counts(spark, sf):
    return X.folded_counts(td.log_lines(spark, sf))


_FRAMES = f"""
  WITH f AS (SELECT *, regexp_matches(line, '^\\s+at\\s+.+?:\\d+:\\d+') OR regexp_matches(line, '(?i)^\\s*(Caused by|Triggered by):') AS frame
    FROM t_logline),
  e AS (SELECT *, (NOT frame AND {trim_sql('line')} = '') OR {_PRIORITY} AS ends FROM f),
  n AS (SELECT *, coalesce(sum(ends::INT) OVER ({_IN_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM e),
  k AS (SELECT *, row_number() OVER (PARTITION BY scope_id, doc_id, block ORDER BY line_no) AS a,
      count(*) OVER (PARTITION BY scope_id, doc_id, block) AS c FROM n WHERE frame)
"""


@query("stack_blocks", _FRAMES + """
  SELECT scope_id, doc_id, line_no, line, 'top' AS part FROM k WHERE a <= 2
  UNION ALL SELECT scope_id, doc_id, line_no, line, 'bottom' FROM k WHERE c > 2 AND a > c - 1""")
def stack_blocks(spark, sf):
    return X.stack_blocks(td.log_lines(spark, sf), head=2, tail=1, long=2)


@query("brace_depth", f"""
  SELECT scope_id, doc_id, line_no, CAST(sum(length(line) - length(replace(line, '{{', '')) - length(line) + length(replace(line, '}}', '')))
    OVER ({_IN_ORDER}) AS BIGINT) AS depth FROM t_codeline""")
def brace_depth(spark, sf):
    return X.brace_depth(td.code_lines(spark, sf)).drop("line")


@query("time_range", """
  SELECT scope_id, doc_id, arg_min(a, line_no) AS first_timestamp, arg_max(a, line_no) AS last_timestamp FROM (
    SELECT *, regexp_extract(line, '\\b(\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?Z?)\\b', 1) AS a FROM t_logline)
  WHERE a != '' GROUP BY ALL""")
def time_range(spark, sf):
    return X.time_range(td.log_lines(spark, sf))


@query("markdown_sections", f"""
  WITH l AS (SELECT scope_id, doc_id, unnest(ls) AS line, unnest(generate_series(0, len(ls) - 1)) AS line_no
    FROM (SELECT *, string_split(replace(content, '- timeout', '```'), chr(10)) AS ls FROM t_mddoc)),
  f AS (SELECT *, sum(starts_with({trim_sql('line')}, '```')::INT) OVER ({_IN_ORDER}) % 2 = 1 AS in_fence FROM l),
  h AS (SELECT *, NOT in_fence AND regexp_matches(line, '^(#{{1,6}})\\s+(.+)$') AS is_heading FROM f),
  s AS (SELECT *, sum(is_heading::INT) OVER ({_IN_ORDER}) AS section FROM h)
  SELECT scope_id, doc_id, CAST(section AS BIGINT) AS section, count(*) AS lines, count_if(in_fence) AS fenced FROM s GROUP BY ALL""")
def markdown_sections(spark, sf):
    docs = td.markdown_documents(spark, sf).withColumn(
        "content", F.replace("content", F.lit("- timeout"), F.lit("```")))
    marked = X.markdown_sections(X.lines(docs))
    return marked.groupBy("scope_id", "doc_id", "section").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("in_fence").alias("fenced"))


@query("fit_prefix", f"""
  SELECT scope_id, doc_id, line_no, CAST(t AS BIGINT) AS tokens_so_far FROM (
    SELECT *, sum({tokens_sql('line')}) OVER ({_IN_ORDER}) AS t FROM t_logline) WHERE t <= 120""")
def fit_prefix(spark, sf):
    return X.fit_prefix(td.log_lines(spark, sf), 120).drop("line")
