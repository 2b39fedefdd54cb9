"""Queries over the compressors, the safety plan and the context flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, round_sql, tokens_sql, trim_sql
from corpusmill.operators.compress import compress, type_facts
from corpusmill.operators.compress import conversation, plain_text
from corpusmill.operators.compress.common import shares_fallback
from corpusmill.operators.compress.log import sample_fallback
from corpusmill import schemas
from corpusmill.operators.route import route
from corpusmill.plans import context_flow as flow
from corpusmill.plans import overview as O
from corpusmill.plans import safety as S
from corpusmill.session import written
from corpusmill.sources import testdata as td
from corpusmill.sources.store import conform, new_compressed

_B = chr(92) + "b"


def _facts(docs, kind):
    typed = docs.withColumn("content_type", F.lit(kind))
    return type_facts(typed, kind).select("doc_id", "kind", F.col("ord").cast("bigint").alias("ord"), "value")


_PRIORITY = "regexp_matches(upper(line), 'FATAL|ERROR|WARN|EXCEPTION|TRACEBACK')"


def _numbered(kind: str, rows: str) -> str:
    """Facts of one kind from rows(doc_id, line_no, value)."""
    return f"SELECT doc_id, '{kind}' AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS ord, value FROM ({rows})"


def _first(kind: str, rows: str) -> str:
    return _numbered(kind, f"SELECT doc_id, value, min(line_no) AS line_no FROM ({rows}) WHERE value != '' GROUP BY doc_id, value")


_LOG = f"""
  WITH l AS (SELECT *, {_PRIORITY} AS p FROM t_logline),
  f AS (SELECT *, regexp_matches(line, '^\\s+at\\s+.+?:\\d+:\\d+') OR regexp_matches(line, '(?i)^\\s*(Caused by|Triggered by):') AS frame FROM l),
  n AS (SELECT *, coalesce(sum((p OR (NOT frame AND {trim_sql('line')} = ''))::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM f),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY line_no) AS a, count(*) OVER (PARTITION BY doc_id, block) AS c FROM n WHERE frame)
  {_numbered('priority_line', 'SELECT doc_id, line_no, line AS value FROM l WHERE p')}
  UNION ALL {_first('trace_id', "SELECT doc_id, line_no, regexp_extract(line, '(?i)(trace[_-]?id|request[_-]?id|correlation[_-]?id)[=:]\\s*(\\S+)', 2) AS value FROM l")}
  UNION ALL {_first('exception', f"SELECT doc_id, line_no, regexp_extract(line, '{_B}([A-Z][a-zA-Z]*(Error|Exception|Fault|Failure)){_B}', 1) AS value FROM l WHERE p")}
  UNION ALL {_first('file', "SELECT doc_id, line_no, regexp_extract(line, '(?i)(at |in |from )([/\\w.-]+\\.[a-z]{2,6}):(\\d+)', 2) AS value FROM l")}
  UNION ALL {_numbered('stack_top', 'SELECT doc_id, line_no, line AS value FROM k WHERE a <= 5')}
  UNION ALL {_numbered('stack_bottom', 'SELECT doc_id, line_no, line AS value FROM k WHERE c > 8 AND a > c - 3')}
"""


@query("log_facts", _LOG)
def log_facts(spark, sf):
    rows = _facts(td.as_documents(td.log_lines(spark, sf)), "log")
    return rows.filter(F.col("kind").isin("priority_line", "trace_id", "exception", "file", "stack_top", "stack_bottom"))


@query("log_noise_facts", f"""
  WITH f AS (SELECT *, NOT {_PRIORITY} AND regexp_matches(upper(line), 'INFO|DEBUG') AS info,
      NOT {_PRIORITY} AND regexp_matches(line, '(?i){_B}(heartbeat|ping|keep-?alive|healthcheck){_B}') AS beat FROM t_logline),
  r AS (SELECT *, sum((NOT info)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS ir, sum((NOT beat)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS br FROM f),
  i AS (SELECT doc_id, sum(greatest(n - 3, 0)) AS x FROM (SELECT doc_id, ir, count(*) AS n FROM r WHERE info GROUP BY ALL) GROUP BY doc_id),
  b AS (SELECT doc_id, sum(greatest(n - 2, 0)) AS x FROM (SELECT doc_id, br, count(*) AS n FROM r WHERE beat GROUP BY ALL) GROUP BY doc_id),
  d AS (SELECT DISTINCT doc_id FROM t_logline)
  SELECT d.doc_id, 'folded_info' AS kind, CAST(coalesce(i.x, 0) AS VARCHAR) AS value FROM d LEFT JOIN i ON d.doc_id = i.doc_id
  UNION ALL SELECT d.doc_id, 'folded_heartbeats', CAST(coalesce(b.x, 0) AS VARCHAR) FROM d LEFT JOIN b ON d.doc_id = b.doc_id""")
def log_noise_facts(spark, sf):
    rows = _facts(td.as_documents(td.log_lines(spark, sf)), "log")
    return rows.filter(F.col("kind").startswith("folded_")).select("doc_id", "kind", "value")


_TS = r"(?i)^(.+?)\((\d+),(\d+)\):\s*error\s+(\w+)[: ]?\s*(.*)"


@query("command_output_facts", f"""
  WITH e AS (SELECT doc_id, line_no, regexp_extract(line, '{_TS}', 1) AS f, regexp_extract(line, '{_TS}', 2) AS l, regexp_extract(line, '{_TS}', 3) AS c,
      regexp_extract(line, '{_TS}', 4) AS code, regexp_extract(line, '{_TS}', 5) AS m FROM t_cmdline WHERE regexp_matches(line, '{_TS}')),
  u AS (SELECT doc_id, min(line_no) AS line_no, f || '|' || l || '|' || arg_min(c, line_no) || '|' || code || '|' || arg_min(m, line_no) AS value FROM e GROUP BY doc_id, f, l, code)
  {_numbered('error', 'SELECT * FROM u')}
  UNION ALL {_numbered('stderr', "SELECT doc_id, line_no, line AS value FROM t_cmdline WHERE contains(lower(line), 'stderr')")}
  UNION ALL SELECT DISTINCT doc_id, 'command', 0, 'npm run build' FROM t_cmdline
  UNION ALL SELECT doc_id, 'exit_code', 0, regexp_extract(line, 'exit code (\\d+)', 1) FROM t_cmdline WHERE regexp_matches(line, 'exit code \\d+')
  UNION ALL SELECT doc_id, 'failure', 0, line FROM t_cmdline WHERE line = 'Build failed with errors'
  UNION ALL SELECT doc_id, 'folded_lines', 0, CAST(count_if(starts_with(line, 'npm install')) AS VARCHAR) FROM t_cmdline GROUP BY doc_id""")
def command_output_facts(spark, sf):
    return _facts(td.as_documents(td.command_lines(spark, sf)), "command_output")


@query("test_output_facts", """
  WITH h AS (SELECT doc_id, trim(regexp_extract(line, '^\\s*FAIL\\s+(.+)', 1)) AS file FROM t_testline WHERE line_no = 2),
  x AS (SELECT t.doc_id, t.line_no, h.file, trim(substr(trim(t.line), 2)) AS name FROM t_testline t JOIN h ON t.doc_id = h.doc_id WHERE trim(t.line) LIKE '×%'),
  w AS (SELECT x.doc_id, x.line_no, x.file, x.name, arg_min(regexp_extract(l.line, 'AssertionError: (.+)', 1), l.line_no) FILTER (l.line LIKE 'AssertionError%') AS message,
      arg_min(regexp_extract(l.line, 'Expected: (.+)', 1), l.line_no) FILTER (l.line LIKE 'Expected%') AS e,
      arg_min(regexp_extract(l.line, 'Received: (.+)', 1), l.line_no) FILTER (l.line LIKE 'Received%') AS r,
      arg_min(regexp_extract(l.line, 'at (.+)', 1), l.line_no) FILTER (trim(l.line) LIKE 'at %') AS loc
    FROM x JOIN t_testline l ON x.doc_id = l.doc_id AND l.line_no > x.line_no AND l.line_no <= x.line_no + 39 GROUP BY ALL)
  SELECT doc_id, 'failed_test' AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS ord,
    file || '|' || name || '|AssertionError|' || message || '|' || e || '|' || r || '|' || loc AS value FROM w
  UNION ALL SELECT DISTINCT doc_id, 'status', 0, 'FAILED' FROM t_testline UNION ALL SELECT DISTINCT doc_id, 'framework', 0, 'vitest' FROM t_testline
  UNION ALL SELECT doc_id, 'command', 0, substr(line, 3) FROM t_testline WHERE line_no = 0
  UNION ALL SELECT doc_id, 'exit_code', 0, '1' FROM t_testline WHERE line = 'exit code: 1'""")
def test_output_facts(spark, sf):
    return _facts(td.as_documents(td.test_lines(spark, sf)), "test_output")


@query("json_facts", """
  SELECT e AS doc_id, unnest(['key','key','key','key','key','key','array','array','folded_arrays','folded_texts']) AS kind,
    unnest([0,1,2,3,4,5,0,1,0,0])::BIGINT AS ord, unnest(['id|number','status|string','user|object','items|array<number>','rows|array<object>','note|string',
      'items|7','rows|2','1', CASE WHEN (k % 50 + 20) * 5 > 200 THEN '1' ELSE '0' END]) AS value FROM t_ev""")
def json_facts(spark, sf):
    return _facts(td.json_documents(spark, sf), "json").filter(F.col("kind") != "special_field")


@query("json_special_fields", """
  SELECT e AS doc_id, unnest(['id=' || e, 'status="' || kind || '"', 'user.userId=' || u, 'user.errorCode="E' || k || '"',
    'rows[0].id=' || k, 'rows[0].code="c1"', 'rows[1].code="c2"']) AS value FROM t_ev""")
def json_special_fields(spark, sf):
    rows = _facts(td.json_documents(spark, sf), "json")
    return rows.filter(F.col("kind") == "special_field").select("doc_id", "value")


@query("json_deep_fields", """
  WITH d AS (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(0, len(ls) - 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  i AS (SELECT doc_id, i, 'items[' || i || '].' AS place FROM d)
  SELECT doc_id, 'deep' || repeat('.l', CAST(doc_id % 40 AS BIGINT)) || '.errorCode="E' || doc_id || '"' AS value FROM documents
  UNION ALL SELECT doc_id, place || 'code="c' || i || '"' FROM i UNION ALL SELECT doc_id, place || 'part.parts[0].statusOf=' || i FROM i
  UNION ALL SELECT doc_id, place || 'name="same"' FROM i WHERE i = 0""")
def json_deep_fields(spark, sf):
    """Every line of a document as an item, beside an object nested up to 40 levels."""
    rows = _facts(td.deep_json_documents(spark, sf), "json")
    return rows.filter(F.col("kind") == "special_field").select("doc_id", "value")


_PRIORITY_WORDS = rf"(?i){_B}(?:rollback|critical|warning|security|failure|readiness|required){_B}"
_STRUCTURED = "(?i)" + "|".join([
    r"(?:^|\s)(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+\/\S+", r"\/(?:api|v\d+)(?:\/[A-Za-z0-9._~!$&''()*+,;=:@%-]+)+",
    r"\b\d+(?:\.\d+)?\s*(?:ms|s|sec(?:onds?)?|m|min(?:utes?)?|h|hours?|kb|mb|gb|%|retries?|requests?|tokens?|bytes?)\b",
    r"(?:<=|>=|<|>|=)\s*\d+(?:\.\d+)?", r"(?:^|\s)(?:npm|pnpm|yarn|npx|node|git|docker|kubectl|mvn|gradle|cargo|python|pip|go)\s+[^\n]+",
    r"(?:^|\s)(?:[A-Z][A-Z0-9_]{2,}|[a-z][A-Za-z0-9]*(?:\.[A-Za-z0-9_-]+)+)\s*[:=]",
    r"`(?:[A-Z][A-Z0-9_]{2,}|[a-z][a-z0-9_]*(?:[._-][a-z0-9_]+)+)`"])


@query("markdown_facts", f"""
  WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(0, len(ls) - 1)) AS i FROM (SELECT *, string_split(content, chr(10)) AS ls FROM t_mddoc)),
  h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+.+$') AS is_h FROM l), s AS (SELECT *, sum(is_h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
  b AS (SELECT DISTINCT ON (doc_id, sec, t) doc_id, sec, {trim_sql('line')} AS t FROM s WHERE NOT is_h),
  v AS (SELECT doc_id, sec, sum(CASE WHEN t = '' THEN 0 WHEN regexp_matches(t, '{_STRUCTURED}') THEN 50
      WHEN regexp_matches(t, '{_PRIORITY_WORDS}') OR regexp_matches(t, '^(?:[-*+]\\s+|\\d+[.)]\\s+)') THEN 15 ELSE 0 END) AS pts,
    max(regexp_matches(t, '{_PRIORITY_WORDS}')::INT) AS hot FROM b GROUP BY ALL),
  g AS (SELECT doc_id, sec, min(i) AS start, max(i) AS stop, arg_min(line, i) AS head FROM s WHERE sec > 0 GROUP BY ALL)
  SELECT g.doc_id, 'section' AS kind, g.sec - 1 AS ord, regexp_replace(head, '^#+\\s+', '') || '|' ||
      CASE WHEN head LIKE '%Component%' THEN 'component' WHEN head LIKE '%Rollback%' THEN 'rollback plan #' ELSE 'topic #' END || '|' ||
      (CASE WHEN head LIKE '%Rollback%' THEN 1250 WHEN hot = 1 THEN 1000 ELSE 20 END + CAST(least(pts, 240) AS BIGINT)) || '|' || (start + 1) || '|' || (stop + 1) AS value
  FROM g JOIN v ON g.doc_id = v.doc_id AND g.sec = v.sec""")
def markdown_facts(spark, sf):
    rows = _facts(td.markdown_documents(spark, sf), "markdown")
    return rows.filter(F.col("kind") == "section")


_SECTIONS = f"""
  t AS (SELECT doc_id, content, {trim_sql('content')} AS x FROM t_corpus),
  p AS (SELECT *, list_filter(regexp_split_to_array(x, '\\n\\n+'), lambda y: y != '') AS paras, string_split(x, chr(10)) AS ls FROM t),
  q AS (SELECT doc_id, content, CASE WHEN x = '' THEN [] WHEN len(regexp_split_to_array(x, '\\n\\n+')) > 1 THEN paras
      WHEN len(ls) >= 5 THEN list_filter(ls, lambda y: y != '') ELSE [x] END AS parts FROM p),
  u AS (SELECT doc_id, unnest(parts) AS part, unnest(generate_series(0, len(parts) - 1)) AS i, len(parts) AS n FROM q),
  v AS (SELECT *, {trim_sql('part')} AS s, split_part({trim_sql('part')}, chr(10), 1) AS f FROM u),
  w AS (SELECT *, CASE WHEN i = 0 THEN 50 WHEN i = n - 1 THEN 30 WHEN i <= ceil(n * 0.15::DOUBLE) THEN 10 WHEN i >= floor(n * 0.85::DOUBLE) THEN 5 ELSE 0 END
      + CASE WHEN regexp_matches(f, '^#{{1,6}}\\s') THEN 40 ELSE 0 END
      + CASE WHEN regexp_matches(part, '^[^\\n]*\\S[^\\n]*\\n\\s*(={{3,}}|-{{3,}})\\s*(\\n|$)') THEN 25 ELSE 0 END
      + CASE WHEN length(f) BETWEEN 3 AND 80 AND regexp_matches(f, '^[A-Z0-9\\s_\\-/:]+$') AND length(regexp_replace(f, '\\s', '', 'g')) >= 3 THEN 15 ELSE 0 END
      + CASE WHEN regexp_matches(s, '(?i){_B}(error|fail|fatal|exception|panic|crash|critical|cannot|unable|refused|timeout|rejected|denied|invalid|stack trace|traceback|backtrace){_B}') THEN 12
        WHEN regexp_matches(s, '(?i){_B}(warn(ing)?|alert|caution|attention|notice|deprecated|obsolete|outdated|unstable){_B}') THEN 8
        WHEN regexp_matches(s, '(?i){_B}(important|note|key|crucial|essential|significant|todo|fixme|hack|xxx|review|summary|overview|conclusion|result){_B}') THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(s, '(?m)^[\\s]*[-*+]\\s|^[\\s]*\\d+[.)]\\s') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(s, '`{{1,3}}[^`]+`{{1,3}}') THEN 5 ELSE 0 END
      + CASE WHEN regexp_matches(s, '(?i)[/\\\\][\\w.-]+\\.[a-z]{{2,6}}{_B}') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(s, '{_B}https?://\\S+') THEN 5 ELSE 0 END
      + CASE WHEN length(s) BETWEEN 40 AND 800 THEN 5 ELSE 0 END - CASE WHEN length(s) > 2000 THEN 10 ELSE 0 END
      - CASE WHEN length(s) < 20 AND NOT regexp_matches(f, '^#{{1,6}}\\s') THEN 5 ELSE 0 END AS score FROM v)
"""


@query("plain_text_sections", f"WITH {_SECTIONS} SELECT doc_id, i AS ord, score || ':' || part AS value FROM w")
def plain_text_sections(spark, sf):
    return _facts(td.corpus(spark, sf), "plain_text").select("doc_id", "ord", "value")


@query("plain_text_selection", f"""
  WITH {_SECTIONS},
  m AS (SELECT doc_id, n, list(CASE WHEN i > 0 AND i < n - 1 THEN {{'i': i, 't': {tokens_sql('part')} + 1}} END ORDER BY score DESC, i) AS mids,
      sum(CASE WHEN i = 0 OR i = n - 1 THEN {tokens_sql('part')} END) + 2 AS ends FROM w WHERE n > 3 GROUP BY doc_id, n),
  k AS (SELECT doc_id, n, ends, list_reduce(list_filter(mids, lambda x: x IS NOT NULL), lambda a, x: CASE WHEN a.used + x.t <= 300
      THEN {{'used': CAST(a.used + x.t AS BIGINT), 'kept': list_append(a.kept, x.i)}} ELSE a END, {{'used': CAST(ends AS BIGINT), 'kept': []::BIGINT[]}}).kept AS kept FROM m)
  SELECT doc_id, CASE WHEN ends <= 300 THEN array_to_string(list_sort(list_concat([0::BIGINT, n - 1], kept)), ',') END AS kept FROM k""")
def plain_text_selection(spark, sf):
    parts = td.corpus(spark, sf).withColumn("parts", plain_text.sections(F.col("content")))
    kept = plain_text.keep_best(F.col("parts"), 300)
    return parts.filter(F.size("parts") > 3).select("doc_id", F.array_join(kept.cast("array<string>"), ",").alias("kept"))


@query("rag_chunk_facts", f"""
  WITH c AS (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(0, len(ls) - 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  x AS (SELECT doc_id, i, 'file_' || (i % 4) AS src, ('0.' || ((i * 37 + doc_id) % 90 + 10))::DOUBLE AS score,
    {trim_sql("('source: file_' || (i % 4) || chr(10) || 'title: Title ' || doc_id || chr(10) || 'chunk_id: c_' || i || chr(10) || 'score: 0.' || ((i * 37 + doc_id) % 90 + 10) || chr(10) || line)")} AS head FROM c),
  d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, src, head ORDER BY score DESC, i) AS r, min(i) OVER (PARTITION BY doc_id, src, head) AS place FROM x)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) - 1 AS ord, src || '|Title ' || doc_id || '|c_' || i || '|' || score AS value
  FROM d WHERE r = 1""")
def rag_chunk_facts(spark, sf):
    # a text line that opens with one of the labels would start a passage of its own
    rows = _facts(td.rag_documents(spark, sf), "rag_chunk")
    return rows.filter(F.col("kind") == "chunk").select("doc_id", "ord", "value")


_SCORE = f"""
  greatest(0, 10 + CASE WHEN role = 'system' THEN 30 ELSE 0 END + CASE WHEN role = 'user' AND i = 0 THEN 40 ELSE 0 END
    + CASE WHEN regexp_matches(content, '(?i){_B}(goal|objective|task|need to|want to|fix|implement|build|create|add|remove|change|update){_B}') THEN 30 ELSE 0 END
    + CASE WHEN regexp_matches(content, '(?i){_B}(decided|decision|decisions|agreed|chose|opted|settled on|going to go with|we will|we should|let''?s go with){_B}') THEN 25 ELSE 0 END
    + CASE WHEN regexp_matches(content, '{_B}(error|Error|ERROR|fail|FAIL|exception|Exception|crash|bug|Bug|broken){_B}') THEN 20 ELSE 0 END
    + CASE WHEN regexp_matches(content, '{_B}(src|lib|tests?|docs?|app|components?|utils?|services?|configs?)/[\\w./-]+\\.[\\w]{{1,6}}{_B}') THEN 15 ELSE 0 END
    + CASE WHEN contains(content, '```') THEN 15 ELSE 0 END
    + CASE WHEN regexp_matches(content, '(?im)^\\s*(-\\s*\\[x\\]|✓|✅|✔️|done:)\\s*(.+)|^\\s*(-\\s*\\[\\s\\]|⬜|⭕|todo:)\\s*(.+)') THEN 20 ELSE 0 END
    - CASE WHEN regexp_matches(t, '(?i){_B}(hi|hello|hey|thanks|thank you|you''?re welcome|great|awesome|cool|okay|sure|got it|no problem|np){_B}') AND length(t) < 100 THEN 15 ELSE 0 END
    - CASE WHEN length(t) < 20 AND NOT regexp_matches(t, '(?i)error|fail|goal|decision') THEN 20 ELSE 0 END - CASE WHEN length(t) > 1000 THEN 10 ELSE 0 END
    + CAST(least(15, floor(i / n * 15)) AS BIGINT))
"""


@query("top_messages", f"""
  WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, {trim_sql('content')} AS t FROM t_msg),
  s AS (SELECT *, {_SCORE} AS score FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM s)
  SELECT conv_id, turn, score, rank FROM r WHERE rank <= greatest(least(15, n), ceil(n * 0.4::DOUBLE))""")
def top_messages(spark, sf):
    top = conversation.top_messages(td.messages(spark, sf))
    return top.select("conv_id", "turn", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("code_outline_facts", """
  WITH l AS (SELECT *, 'L' || (line_no + 1) || ': ' || trim(line) AS v FROM t_codeline)
  SELECT doc_id, 'imports' AS kind, v AS value FROM l WHERE line_no = 0 UNION ALL SELECT doc_id, 'exports', v FROM l WHERE line_no = 1
  UNION ALL SELECT doc_id, 'todo', 'L' || (line_no + 1) || ': ' || line FROM l WHERE line_no = 2 UNION ALL SELECT doc_id, 'classes', v FROM l WHERE line_no = 6
  UNION ALL SELECT doc_id, 'function', v FROM l WHERE line_no >= 16 AND line_no % 4 = 0
  UNION ALL SELECT doc_id, 'type', v || chr(10) || '  name: string;' || chr(10) || '}' FROM l WHERE line_no = 3 UNION ALL SELECT doc_id, 'type', v FROM l WHERE line_no = 14
  UNION ALL SELECT doc_id, 'api', v FROM l WHERE line_no >= 16 AND line_no % 4 = 0
  UNION ALL SELECT doc_id, 'api', 'L' || (line_no + 1) || ': public price(q: number): number { /* ... */ }' FROM l WHERE line_no = 7
  UNION ALL SELECT doc_id, 'folded', CAST(1 + count_if(line_no >= 16 AND line_no % 4 = 2 AND line NOT LIKE '%throw%') AS VARCHAR) FROM l GROUP BY doc_id""")
def code_outline_facts(spark, sf):
    rows = _facts(td.as_documents(td.code_lines(spark, sf)), "code")
    return rows.filter(~F.col("kind").isin("relevant", "file")).select("doc_id", "kind", "value")


@query("conversation_facts")
def conversation_facts(spark, sf):
    return _facts(td.conversation_documents(spark, sf), "conversation_history")


@query("truncated_outputs", f"""
  WITH d AS (SELECT doc_id, string_split(content, chr(10)) AS ls FROM (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM t_cmdline GROUP BY doc_id)),
  c AS (SELECT doc_id, ls, len(ls) AS n, CAST(ceil(len(ls) * 0.2::DOUBLE) AS BIGINT) AS h, CAST(ceil(len(ls) * 0.3::DOUBLE) AS BIGINT) AS t FROM d)
  SELECT doc_id, left(array_to_string(list_concat(ls[1:h], ['[... ' || greatest(0, n - h - t) || ' lines folded ...]'], ls[n - t + 1 : n]), chr(10)), 800) AS text FROM c""")
def truncated_outputs(spark, sf):
    docs = td.as_documents(td.command_lines(spark, sf))
    return docs.select("doc_id", shares_fallback(F.col("content"), 200, "command_output").alias("text"))


@query("sampled_logs", f"""
  WITH o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM t_logline WHERE NOT {_PRIORITY}),
  s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, any_value(n) - count(*) AS gone FROM o WHERE r % greatest(1, ceil(n / 20)) = 0 GROUP BY doc_id),
  p AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM t_logline WHERE {_PRIORITY} GROUP BY doc_id)
  SELECT s.doc_id, left(coalesce(p.text || chr(10), '') || '[... ' || gone || ' lines folded ...]' || chr(10) || s.text, 2000) AS text FROM s LEFT JOIN p ON s.doc_id = p.doc_id""")
def sampled_logs(spark, sf):
    docs = td.as_documents(td.log_lines(spark, sf))
    return docs.select("doc_id", sample_fallback(F.col("content"), 500).alias("text"))


def _register(kind: str) -> None:
    @query(f"compress_{kind}")
    def one(spark, sf):
        docs = td.typed_corpus(spark, sf).filter(F.col("content_type") == kind)
        done = compress(docs, 120, types=[kind])
        return done.select("doc_id", "compressed_content", "summary", "strategy", "tokens_before", "tokens_after",
                           "tokens_saved", "compression_ratio", "failed")


for _kind in ("log", "test_output", "command_output", "code", "json", "markdown", "plain_text", "rag_chunk", "conversation_history"):
    _register(_kind)


@query("compression_invariants", f"""
  SELECT content_type, count(*) AS documents, count(*) AS within_budget, 0::BIGINT AS failed,
    CAST(sum({tokens_sql('content')}) AS BIGINT) AS tokens_before FROM t_typed GROUP BY content_type""")
def compression_invariants(spark, sf):
    """Every compressor keeps to the budget and never fails on well-formed input."""
    done = compress(td.typed_corpus(spark, sf), 200)
    return done.groupBy("content_type").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if((F.col("tokens_after") <= 200) | (F.col("tokens_after") <= F.col("tokens_before"))).alias("within_budget"),
        F.count_if("failed").alias("failed"), F.sum("tokens_before").alias("tokens_before"))


@query("strategies_used", """
  SELECT content_type, (CASE content_type WHEN 'markdown' THEN 'markdown_conservative_v2' ELSE content_type || '_conservative_v1' END) AS strategy, count(*) AS n
  FROM t_typed GROUP BY content_type""")
def strategies_used(spark, sf):
    done = compress(td.typed_corpus(spark, sf), 200)
    return done.groupBy("content_type", "strategy").agg(F.count(F.lit(1)).alias("n"))


def _safe(spark, sf):
    docs = td.corpus(spark, sf).withColumn("content_type", F.lit("plain_text"))
    return S.safe_compress(docs, max_tokens=300, max_input_bytes=6000, chunk_tokens=500,
                           types=["plain_text"])


@query("safe_compression", """
  SELECT doc_id, CASE WHEN octet_length(encode(content)) > 6000 THEN 'chunked' ELSE 'size_ok' END AS safety_action,
    octet_length(encode(content)) > 6000 AS chunk_headers, false AS failed FROM t_corpus""")
def safe_compression(spark, sf):
    done = _safe(spark, sf)
    return done.select("doc_id", "safety_action", F.col("compressed_content").rlike(r"\A\[Chunk 1/\d+\]\n").alias("chunk_headers"), "failed")


@query("compression_failures")
def compression_failures(spark, sf):
    return S.compression_failures(_safe(spark, sf), td.NOW).select("failure_id", "event_type", "error_reason")


@query("oversized_events", """
  SELECT 'fev_' || sha256('oversized_input|' || scope_id || '|' || doc_id) AS failure_id, 'input_exceeded_size_limit' AS error_reason
  FROM t_corpus WHERE octet_length(encode(content)) > 5000""")
def oversized_events(spark, sf):
    docs = td.corpus(spark, sf).withColumn("content_type", F.lit("plain_text"))
    done = S.safe_compress(docs, 300, max_input_bytes=5000, enable_chunking=False, types=["plain_text"])
    events = S.compression_failures(done, td.NOW)
    return events.filter(F.col("event_type") == "oversized_input").select("failure_id", "error_reason")


def _cache(spark, sf):
    """Every document asked for twice; every third one is known, half of those lost their original."""
    d = F.col("doc_id")
    docs = S.with_cache_key(td.corpus(spark, sf).withColumn("content_type", F.lit("plain_text")), 2000)
    known = docs.filter(d % 3 == 0).dropDuplicates(["scope_id", "cache_key"]).select(
        F.concat(F.lit("ccr_"), F.substring("cache_key", 7, 12)).alias("ccr_id"), "scope_id", "cache_key",
        F.lit("x").alias("compressed_content"), F.concat(F.lit("orig_"), F.substring("cache_key", 7, 12)).alias("original_ref"))
    from corpusmill.sources.store import conform, new_compressed
    from corpusmill import schemas
    compressed = new_compressed(known, td.NOW)
    kept = known.filter(F.substring("cache_key", 7, 1) < "8").select(F.col("original_ref").alias("original_id"), "scope_id", "ccr_id")
    originals = conform(kept, schemas.ORIGINALS)
    twice = docs.withColumn("request_id", F.explode(F.array(d * 2, d * 2 + 1)))
    return S.reuse_cache(twice, compressed, originals, td.NOW)


_KEYS = """
  WITH k AS (SELECT doc_id, scope_id, 'cache_' || sha256(scope_id || '::' || sha256(content) || '::plain_text::1.0.0::2000::1') AS key FROM t_corpus),
  c AS (SELECT DISTINCT scope_id, key FROM k WHERE doc_id % 3 = 0)
"""


@query("cache_hits", _KEYS + """
  SELECT k.doc_id, r AS request_id, 'ccr_' || substr(k.key, 7, 12) AS ccr_id, substr(k.key, 7, 1) >= '8' AS needs_repair
  FROM (SELECT *, unnest([doc_id * 2, doc_id * 2 + 1]) AS r FROM k) k JOIN c ON k.scope_id = c.scope_id AND k.key = c.key""")
def cache_hits(spark, sf):
    return _cache(spark, sf).hits.select("doc_id", "request_id", "ccr_id", "needs_repair")


@query("cache_misses", _KEYS + """
  SELECT min(doc_id * 2) AS request_id, key AS cache_key FROM k WHERE (scope_id, key) NOT IN (SELECT (scope_id, key) FROM c) GROUP BY scope_id, key""")
def cache_misses(spark, sf):
    return _cache(spark, sf).misses.select("request_id", "cache_key")


@query("cache_hit_counts", _KEYS + """
  SELECT 'ccr_' || substr(c.key, 7, 12) AS ccr_id, count(*) * 2 AS cache_hit_count FROM c JOIN k ON k.scope_id = c.scope_id AND k.key = c.key GROUP BY c.key""")
def cache_hit_counts(spark, sf):
    return _cache(spark, sf).compressed.select("ccr_id", "cache_hit_count")


_FLOWS: dict = {}


def _flow(spark, sf):
    """One run of the flow for all queries that look at it: its tables are written, not planned again."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FLOWS:
        _FLOWS[key] = _run_flow(spark, sf)
    return _FLOWS[key]


def _run_flow(spark, sf):
    d = F.col("doc_id")

    def pick(*values, n):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (d % n + 1).cast("int"))

    requests = td.page_corpus(spark, sf).select(
        F.col("doc_id").alias("request_id"), "scope_id", "content", F.lit("").alias("goal"),
        F.when(d % 2 == 0, F.array(F.concat(F.lit("fact "), d))).otherwise(F.array().cast("array<string>")).alias("facts"),
        F.array().cast("array<string>").alias("inferences"),
        pick("VERIFIED", "UNVERIFIED", "UNKNOWN", n=3).alias("verification"), (d % 10 == 0).alias("contradictory"),
        F.when(d % 2 == 0, F.concat(F.lit("fact "), d)).alias("query"))
    # every third page was compressed before; the originals of half of these are gone
    keyed = S.with_cache_key(route(requests.withColumn("doc_id", F.col("request_id"))), 2000).filter(d % 3 == 0)
    keyed = written(keyed.select("doc_id", "scope_id", "cache_key"), "known")
    name = lambda kind: F.concat(F.lit(f"{kind}_known_"), d)
    before = new_compressed(keyed.select(name("ccr").alias("ccr_id"), "scope_id", "cache_key", F.lit("x").alias("compressed_content"), name("orig").alias("original_ref")), td.NOW)
    stored = conform(keyed.filter(d % 2 == 0).select(name("orig").alias("original_id"), "scope_id", name("ccr").alias("ccr_id")), schemas.ORIGINALS)
    return flow.context_flow(requests, td.memories(spark, sf), td.originals(spark, sf).unionByName(stored), td.NOW, compressed=before)


#: Pages by scope and text, those known before, and which request of a text is the first.
_FLOW = """
  WITH p AS (SELECT doc_id, scope_id, content, bool_or(doc_id % 3 = 0) OVER w AS known, min(doc_id) OVER w AS first,
      min(CASE WHEN doc_id % 6 = 0 THEN doc_id END) OVER w AS whole, min(CASE WHEN doc_id % 3 = 0 THEN 'ccr_known_' || doc_id END) OVER w AS broken
    FROM t_pages WINDOW w AS (PARTITION BY scope_id, content))
"""


@query("flow_cache_reuse", _FLOW + """
  SELECT doc_id AS request_id, known OR doc_id != first AS cache_hit, 'ok' AS persistence, 'ok' AS original FROM p""")
def flow_cache_reuse(spark, sf):
    return _flow(spark, sf).steps.select("request_id", "cache_hit", F.col("persistence.status").alias("persistence"), F.col("original.status").alias("original"))


@query("flow_compressed", _FLOW + """
  SELECT 'ccr_' || sha256(scope_id || '|' || doc_id) AS ccr_id, scope_id, sha256(content) AS content_hash FROM p WHERE NOT known AND doc_id = first""")
def flow_compressed(spark, sf):
    return _flow(spark, sf).compressed.select("ccr_id", "scope_id", "content_hash")


@query("flow_recall", _FLOW + """
  SELECT doc_id AS request_id, CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'skipped' END AS recall, CASE WHEN doc_id % 2 != 0 THEN 'not requested' END AS reason FROM p""")
def flow_recall(spark, sf):
    return _flow(spark, sf).steps.select("request_id", F.col("recall.status").alias("recall"), F.col("recall.reason").alias("reason"))


@query("flow_steps")
def flow_steps(spark, sf):
    return _flow(spark, sf).steps.select(
        "request_id", "status", F.col("compression.status").alias("compression"),
        F.col("memory.status").alias("memory"), F.col("memory.reason").alias("reason"))


@query("flow_receipts", """
  SELECT 'rcp_' || sha256('compress|' || doc_id) AS receipt_id, scope_id, sha256(content) AS input_hash FROM t_pages""")
def flow_receipts(spark, sf):
    return _flow(spark, sf).receipts.select("receipt_id", "scope_id", "input_hash")


@query("flow_originals", _FLOW + """
  SELECT DISTINCT 'orig_' || sha256(scope_id || '|' || content) AS original_id, scope_id FROM p WHERE whole IS NULL""")
def flow_originals(spark, sf):
    return _flow(spark, sf).originals.select("original_id", "scope_id")


@query("project_overview", f"""
  WITH m AS (SELECT scope_id, count(*) AS total, count_if(status = 'active') AS active, count_if(status = 'superseded') AS superseded,
      count_if(status = 'forgotten') AS forgotten, count_if(status = 'expired') AS expired, max(created_at) AS at1 FROM t_mem GROUP BY scope_id),
  c AS (SELECT scope_id, count(*) AS compressions, max(created_at) AS at2 FROM t_ccr GROUP BY scope_id),
  o AS (SELECT scope_id, count(*) AS originals FROM t_orig GROUP BY scope_id),
  r AS (SELECT scope_id, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved, {round_sql('avg(compression_ratio)', 6)} AS avg_compression_ratio FROM t_rcp GROUP BY scope_id)
  SELECT scope_id, coalesce(total, 0) AS total, coalesce(active, 0) AS active, coalesce(superseded, 0) AS superseded, coalesce(forgotten, 0) AS forgotten,
    coalesce(expired, 0) AS expired, coalesce(compressions, 0) AS compressions, coalesce(originals, 0) AS originals, coalesce(tokens_saved, 0) AS tokens_saved,
    avg_compression_ratio, CAST(greatest(at1, at2) AS VARCHAR) AS last_updated
  FROM m FULL JOIN c USING (scope_id) FULL JOIN o USING (scope_id) FULL JOIN r USING (scope_id)""")
def project_overview(spark, sf):
    from corpusmill.functions.text import round_half_up
    view = O.overview(td.memories(spark, sf), td.compressed(spark, sf), td.originals(spark, sf), td.receipts(spark, sf))
    return view.withColumns({"last_updated": F.col("last_updated").cast("string"),
                             "avg_compression_ratio": round_half_up(F.col("avg_compression_ratio"), 6)})


@query("project_brief", """
  WITH f AS (SELECT f.scope_id, m.type, coalesce(m.summary, left(m.content, 60)) AS text,
      row_number() OVER (PARTITION BY f.scope_id ORDER BY m.confidence DESC, m.created_at DESC, fact_id) AS rank
    FROM t_fact f JOIN t_mem m ON f.source_memory_id = m.memory_id WHERE layer = 'static' AND status = 'active'),
  b AS (SELECT scope_id, type, coalesce(summary, left(content, 80)) AS text, row_number() OVER (PARTITION BY scope_id ORDER BY confidence DESC, memory_id) AS rank
    FROM t_mem WHERE status = 'active'),
  g AS (SELECT scope_id, type, min(rank) AS rank, arg_min(text, rank) AS text FROM b WHERE rank <= 3 GROUP BY ALL)
  SELECT scope_id, 'rule' AS part, rank, type, text FROM f WHERE rank <= 3 UNION ALL SELECT scope_id, 'memory', rank, type, text FROM g""")
def project_brief(spark, sf):
    rows = O.brief(td.memories(spark, sf), td.profile_facts(spark, sf))
    return rows.withColumn("rank", F.col("rank").cast("bigint"))
