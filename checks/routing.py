"""Queries over content routing (I1-I11) and the flagship overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, tokens_sql, trim_sql
from corpusmill.operators import route as R
from corpusmill.sources import testdata as td

# RE2's \b is ASCII, so the signals are written with it here.
_SIGNALS = {
    "test_output": (2, [
        ("AssertionError", "(?i)assertionerror|assertion error"), ("Expected", r"(?i)\bexpected\b[:\s]"),
        ("Received", r"(?i)\breceived\b[:\s]"), ("FAIL", r"\bFAIL(?:ED)?\b"),
        ("test failed", r"(?im)tests?.*(?:failed|FAILED)|(?:failed|FAILED).*tests?|^\d+\s+failed"),
        ("Test Suites", r"(?i)test\s*suites?:"), ("jest", r"(?i)\bjest\b"), ("vitest", r"(?i)\bvitest\b"),
        ("pytest", r"(?i)\bpytest\b"), ("mocha", r"(?i)\bmocha\b"), ("unittest", r"(?i)\bunittest\b")]),
    "log": (2, [
        ("ERROR", r"\bERROR\b"), ("WARN", r"\bWARN(?:ING)?\b"), ("INFO", r"\bINFO\b"),
        ("Exception", r"(?i)\bexception\b"), ("Traceback", r"(?i)\btraceback\b"),
        ("stack trace", r"(?i)stack\s*trace"), ("timestamp", r"\b\d{4}[-/]\d{2}[-/]\d{2}(?:[T ]\d{2}:\d{2})?"),
        ("request id", r"(?i)request[_\-\s]?id"), ("DEBUG", r"\bDEBUG\b"),
        ("error class", r"\b[A-Z]\w*(?:Error|Exception)\b"), ("traceback file", r'(?i)File\s+".+",\s+line\s+\d+')]),
    "command_output": (2, [
        ("stdout", r"(?i)\bstdout\b"), ("stderr", r"(?i)\bstderr\b"),
        ("exit code", r"(?i)exit\s*(?:code|status)[:\s]*\d+"), ("command", r"(?i)\bcommand\b"),
        ("command prompt", r"(?m)^[$#>]\s"), ("build failed", r"(?i)build\s*(?:failed|failure)"),
        ("shell output", r"(?i)shell\s*output"), ("path prompt", r"(?m)^[A-Z]:[\\/].*?>"),
        ("error level", r"(?i)error\s*level")]),
    "code": (3, [
        ("import", r"\bimport\b"), ("export", r"\bexport\b"), ("function", r"\bfunction\b"),
        ("class", r"\bclass\s+\w+"), ("interface", r"\binterface\s+\w+"), ("type", r"\b(?:import\s+)?type\b"),
        ("const", r"\bconst\s+\w+"), ("let", r"\blet\s+\w+"), ("def", r"\bdef\s+\w+"), ("public", r"\bpublic\b"),
        ("private", r"\bprivate\b"), ("return", r"\breturn\b"), ("async", r"\basync\b"),
        ("arrow function", r"=>\s*[{(\[]"), ("enum", r"\benum\s+\w+"), ("extends", r"\bextends\b"),
        ("implements", r"\bimplements\b")]),
    "markdown": (2, [
        ("heading", r"(?m)^#{1,6}\s+\S"), ("unordered list", r"(?m)^\s*[-*+]\s+\S"),
        ("ordered list", r"(?m)^\s*\d+[.)]\s+\S"), ("code block", "```"), ("bold", r"\*\*[^*]+\*\*"),
        ("italic", r"(?:^|[^*])\*[^*]+\*(?:[^*]|$)"), ("link", r"\[.+?\]\(.+?\)"),
        ("table", r"(?m)^\|.+\|.*\n\|[-| :]+\|"), ("blockquote", r"(?m)^>\s")]),
    "rag_chunk": (2, [
        ("source", r"(?i)\bsource(?:_|\b)"), ("chunk", r"(?i)\bchunk(?:_|\b)"), ("document", r"(?i)\bdocument(?:_|\b)"),
        ("metadata", r"(?i)\bmetadata(?:_|\b)"), ("score", r"(?i)\bscore(?:_|\b)"),
        ("chunk_id", r"(?i)\bchunk[_\s]?id\b"), ("document_id", r"(?i)\bdocument[_\s]?id\b"),
        ("excerpt", r"(?i)\bexcerpt\b"), ("relevance", r"(?i)\brelevance\b")]),
    "conversation_history": (2, [
        ("role field", r'"role"\s*:'), ("content field", r'"content"\s*:'), ("user:", r"(?im)^user\s*:"),
        ("assistant:", r"(?im)^(?:assistant|ai|bot)\s*:"), ("system:", r"(?im)^system\s*:"),
        ("human:", r"(?im)^human\s*:"), ("messages array", r'"messages"\s*:'),
        ("conversation", r"(?i)\bconversation\b"), ("turn marker", r"(?im)^={3,}\s*(?:turn|step|message|round)")]),
}
_ORDER = ["test_output", "log", "command_output", "code", "json", "markdown", "rag_chunk", "conversation_history"]


def _signals_sql(t: str) -> str:
    if t == "json":
        c = trim_sql("content")
        return (
            f"CASE WHEN left({c}, 1) IN ('{{', '[') THEN list_filter(['starts with ' || left({c}, 1),"
            f" CASE WHEN json_valid({c}) THEN 'JSON.parse success' WHEN regexp_matches({c}, '\"\\w+\":')"
            f" THEN 'key-value pairs' END], lambda x: x IS NOT NULL) ELSE [] END"
        )
    cases = []
    for name, pattern in _SIGNALS[t][1]:
        quoted = pattern.replace("'", "''")
        cases.append(f"CASE WHEN regexp_matches(content, '{quoted}') THEN '{name}' END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def _confidence_sql(t: str) -> str:
    if t == "json":
        c = trim_sql("content")
        return (f"CASE WHEN len(s) < 2 THEN NULL WHEN list_contains(s, 'JSON.parse success') THEN"
                f" CASE WHEN length({c}) > 20 THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END ELSE 0.4::DOUBLE END")
    least, patterns = _SIGNALS[t]
    total = len(patterns)
    return (f"CASE WHEN len(s) < {least} THEN NULL ELSE least(0.95::DOUBLE, floor((CASE WHEN len(s) >= {total} THEN 0.95::DOUBLE"
            f" ELSE 0.25::DOUBLE + 0.7::DOUBLE * ((len(s) - {least})::DOUBLE / {total - least}) END) * 100 + 0.5::DOUBLE) / 100) END")


def _detect_sql(t: str, table: str) -> str:
    return (f"SELECT doc_id, '{t}' AS content_type, {_confidence_sql(t)} AS confidence,"
            f" array_to_string(s, ',') AS signals, {_ORDER.index(t)} AS prio, content FROM"
            f" (SELECT doc_id, content, {_signals_sql(t)} AS s FROM {table})")


def _route_sql(table: str) -> str:
    union = " UNION ALL ".join(_detect_sql(t, table) for t in _ORDER)
    blank = f"length({trim_sql('content')}) = 0"
    return f"""
      SELECT c.scope_id, c.doc_id, c.content, coalesce(b.content_type, 'unknown') AS content_type,
        CASE WHEN {blank.replace('content', 'c.content')} THEN 1.0::DOUBLE ELSE coalesce(b.confidence, 0.0::DOUBLE) END AS confidence,
        coalesce(b.signals, '') AS signals, coalesce(n, 0) AS candidates
      FROM {table} c LEFT JOIN (
        SELECT doc_id, arg_min(content_type, k) AS content_type, arg_min(confidence, k) AS confidence,
          arg_min(signals, k) AS signals, count(*) AS n
        FROM (SELECT *, (-confidence, prio) AS k FROM ({union}) WHERE confidence >= 0.2 AND NOT {blank})
        GROUP BY doc_id) b ON c.doc_id = b.doc_id"""


def _register(t: str) -> None:
    @query(f"detect_{t}", f"""
      SELECT doc_id, confidence, signals FROM ({_detect_sql(t, 't_typed')}) WHERE confidence IS NOT NULL""")
    def detect(spark, sf):
        found = R.detect(td.typed_corpus(spark, sf), t).filter(F.col("detection").isNotNull())
        return found.select("doc_id", "detection.confidence",
                            F.array_join("detection.signals", ",").alias("signals"))


for _t in _ORDER:
    _register(_t)


@query("corpus_overview", f"""
  SELECT scope_id, content_type, count(*) AS documents, CAST(sum({tokens_sql('content')}) AS BIGINT) AS tokens
  FROM ({_route_sql('t_corpus')}) GROUP BY ALL""")
def corpus_overview(spark, sf):
    routed = R.route(td.corpus(spark, sf))
    from corpusmill.functions.text import token_count
    return routed.groupBy("scope_id", "content_type").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(token_count(F.col("content"))).alias("tokens"))


@query("routed_documents", f"""
  SELECT doc_id, content_type, confidence, signals, candidates, confidence < 0.5 AS low_confidence
  FROM ({_route_sql('t_corpus')})""")
def routed_documents(spark, sf):
    return R.route(td.corpus(spark, sf)).select(
        "doc_id", "content_type", "confidence", F.array_join("signals", ",").alias("signals"),
        F.size("all_results").cast("bigint").alias("candidates"),
        R.low_confidence(F.col("confidence")).alias("low_confidence"))


@query("routed_pages", f"""
  SELECT doc_id, content_type, confidence, signals, candidates FROM ({_route_sql('t_pages')})""")
def routed_pages(spark, sf):
    return R.route(td.page_corpus(spark, sf)).select(
        "doc_id", "content_type", "confidence", F.array_join("signals", ",").alias("signals"),
        F.size("all_results").cast("bigint").alias("candidates"))


_GUESS = f"""
  SELECT doc_id, CASE WHEN length({trim_sql('content')}) = 0 THEN 'unknown'
    WHEN regexp_matches(head, '\\A\\s*[\\[{{]') AND regexp_matches(tail, '[\\]}}]\\s*\\z') AND length(content) <= 100000
      AND json_valid(content) THEN 'json'
    WHEN regexp_matches(head, '\\b(function|class|const|let|var|import|export|return|if|for|while)\\b')::INT
      + regexp_matches(head, '[{{;}}]')::INT + regexp_matches(head, '(?m)^\\s*//')::INT
      + regexp_matches(head, '(?m)^\\s*/\\*')::INT >= 3 THEN 'code'
    WHEN regexp_matches(head, '(?m)^#{{1,6}}\\s') OR regexp_matches(head, '\\*\\*.*\\*\\*')
      OR regexp_matches(head, '\\[.*\\]\\(.*\\)') THEN 'markdown'
    WHEN regexp_matches(head, '(?i)\\b(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\\b')
      OR regexp_matches(head, '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}') THEN 'log'
    WHEN regexp_matches(head, '(?i)\\b(PASS|FAIL|SKIP|OK|passed|failed|tests?)\\b')
      OR regexp_matches(head, '(?i)\\b(assert|expect)\\b') THEN 'test_output' ELSE 'unknown' END AS guess
  FROM (SELECT *, {trim_sql('left(content, 500)')} AS head, {trim_sql('right(content, 100)')} AS tail
    FROM (SELECT doc_id, content FROM t_typed UNION ALL SELECT 'page_' || doc_id, content FROM t_pages))"""


@query("routed_typed_documents", f"""
  SELECT doc_id, content_type, confidence, signals, candidates FROM ({_route_sql('t_typed')})""")
def routed_typed_documents(spark, sf):
    return R.route(td.typed_corpus(spark, sf)).select(
        "doc_id", "content_type", "confidence", F.array_join("signals", ",").alias("signals"),
        F.size("all_results").cast("bigint").alias("candidates"))


@query("guessed_types", _GUESS)
def guessed_types(spark, sf):
    pages = td.page_corpus(spark, sf).select(F.concat(F.lit("page_"), "doc_id").alias("doc_id"), "content")
    every = td.typed_corpus(spark, sf).select("doc_id", "content").unionByName(pages)
    return every.select("doc_id", R.guess_type(F.col("content")).alias("guess"))
