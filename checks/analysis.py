"""Queries over content analysis, decisions and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, trim_sql
from corpusmill.functions.text import round_half_up
from corpusmill.operators import analyze as N
from corpusmill.operators import chunk as C
from corpusmill.sources import testdata as td

_ERROR = (
    r"(?i:\b(error|exception|fail|crash|panic|fatal|abort|timeout)\b)|(?i:\b(syntax\s*error|type\s*error|reference\s*error|range\s*error)\b)"
    r"|\b(E\d{4,}|0x[0-9A-Fa-f]{8})\b|(?i:\bassert(ion)?\s*(failed|error)\b)|\[ERROR\]|\[FATAL\]|\[CRITICAL\]|\[WARN\]"
    r"|(?i:Traceback\s*\(most\s+recent\s+call\s+last\))|^\s*at\s+\S+\s+\(.*:\d+:\d+\)|(?i:Caused by:)|(?i:Exit\s*code:\s*[1-9])"
)
_METRICS = f"""
  SELECT scope_id, doc_id, content, content_type, len(ls) AS line_count,
    len(list_filter(ls, lambda x: regexp_matches(x, '{_ERROR}'))) / len(ls) AS error_density,
    CASE WHEN len(f) > 0 THEN 1.0::DOUBLE - len(list_distinct(f)) / len(f) ELSE 0.0::DOUBLE END AS repetition_ratio
  FROM (SELECT *, list_filter(list_transform(ls, lambda x: {trim_sql('x')}), lambda x: x != '') AS f
    FROM (SELECT *, string_split(content, chr(10)) AS ls FROM t_typed))
"""


@query("content_metrics", f"""
  SELECT doc_id, floor(error_density * 1000 + 0.5::DOUBLE) / 1000 AS error_density,
    floor(repetition_ratio * 1000 + 0.5::DOUBLE) / 1000 AS repetition_ratio, line_count FROM ({_METRICS})""")
def content_metrics(spark, sf):
    m = td.typed_corpus(spark, sf).select("doc_id", N.content_metrics(F.col("content")).alias("m"))
    return m.select("doc_id", round_half_up(F.col("m.error_density"), 3).alias("error_density"),
                    round_half_up(F.col("m.repetition_ratio"), 3).alias("repetition_ratio"),
                    F.col("m.line_count").cast("bigint").alias("line_count"))


def _step_sql(v: str, low: int) -> str:
    return f"CASE WHEN {v} >= {low * 4} THEN 3 WHEN {v} >= {low * 2} THEN 2 WHEN {v} >= {low} THEN 1 ELSE 0 END"


@query("should_compress", f"""
  WITH m AS ({_METRICS}),
  s AS (SELECT *, {_step_sql('length(content)', 2000)} + {_step_sql('ceil(length(content) / 4)', 500)}
      + CASE WHEN content_type IN ('test_output','log','command_output','conversation_history','rag_chunk') THEN 2 WHEN content_type = 'unknown' THEN 0 ELSE 1 END
      - CASE WHEN error_density >= 0.3 THEN 2 ELSE 0 END
      + CASE WHEN repetition_ratio >= 0.3 THEN 2 WHEN repetition_ratio > 0.1 THEN 1 ELSE 0 END
      + CASE WHEN regexp_matches(lower(content_type), 'log|test|output|trace') THEN 1 ELSE 0 END AS score FROM m)
  SELECT doc_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, score / 13)) >= 0.4 AS value,
    floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, score / 13)) * 100 + 0.5::DOUBLE) / 100 AS confidence FROM s""")
def should_compress(spark, sf):
    docs = td.typed_corpus(spark, sf).withColumn("source", F.col("content_type"))
    return N.analyze(docs).select("doc_id", "compress.value", "compress.confidence")


def _group_sql(text: str, patterns) -> str:
    # RE2 has no look-around but an ASCII boundary
    plain = [p.replace(r"(?:\b(?:is|are)\b|(?<=[A-Za-z0-9_]):(?=[A-Za-z0-9_]))", r"\b(?:is|are|:)\b")
             .replace(r"\b|(?<=[A-Za-z0-9_])#\d{2,}(?![A-Za-z0-9_])", r"\b|\b#\d{2,}\b") for p in patterns]
    tests = [f"regexp_matches({text}, '{p.replace(chr(39), chr(39) * 2)}')" for p in plain]
    return "(" + " OR ".join(tests) + ")::INT"


_QUERY_WORDS = ("['what rule applies', 'is this bug known', 'continue the current task', 'which API package', 'say hello',"
                " 'the rule for the API of the bug', '', 'please expand the original log']")


def _asked(spark, sf):
    words = ["what rule applies", "is this bug known", "continue the current task", "which API package", "say hello",
             "the rule for the API of the bug", "", "please expand the original log"]
    n = F.abs(F.hash("doc_id")) * 0 + F.length("content") % 8
    asked = F.element_at(F.array(*[F.lit(w) for w in words]), (n + 1).cast("int"))
    return td.typed_corpus(spark, sf).withColumn("query", asked)


_ASKED = f"(SELECT *, ({_QUERY_WORDS})[length(content) % 8 + 1] AS query FROM t_typed)"


@query("should_recall", f"""
  WITH s AS (SELECT *, content_type = 'conversation_history' AS prior, {_group_sql('query', N.RULE_PATTERNS)} + {_group_sql('query', N.BUG_PATTERNS)}
      + {_group_sql('query', N.TASK_PATTERNS)} + {_group_sql('query', N.ARCHITECTURE_PATTERNS)} AS hits FROM {_ASKED}),
  c AS (SELECT *, CASE WHEN query = '' THEN 0.0::DOUBLE ELSE (hits + prior::INT) / CASE WHEN prior THEN 5 ELSE 4 END END AS share FROM s)
  SELECT doc_id, share >= 0.3 AS value, floor(share * 100 + 0.5::DOUBLE) / 100 AS confidence FROM c""")
def should_recall(spark, sf):
    return N.analyze(_asked(spark, sf)).select("doc_id", "recall.value", "recall.confidence")


@query("should_save_memory", f"""
  WITH t AS (SELECT doc_id, lower(query || chr(10) || content) AS x FROM {_ASKED}),
  s AS (SELECT doc_id, ({_group_sql('x', N.DECIDED)} + {_group_sql('x', N.BUG_FOUND)} + {_group_sql('x', N.WORKING_ON)}
      + ({_group_sql('x', N.PREFERS)} * (length(x) > 100)::INT) + {_group_sql('x', N.CONTRACT_CHANGE)}) / 5 AS share FROM t)
  SELECT doc_id, share >= 0.2 AS value, floor(share * 100 + 0.5::DOUBLE) / 100 AS confidence FROM s""")
def should_save_memory(spark, sf):
    return N.analyze(_asked(spark, sf)).select("doc_id", "save_memory.value", "save_memory.confidence")


@query("should_retrieve_original", f"""
  WITH t AS (SELECT doc_id, query || chr(10) || content AS x, content, content_type FROM {_ASKED}),
  s AS (SELECT doc_id, ({_group_sql('x', N.NAMES_COMPRESSED)} + {_group_sql('x', N.WANTS_EXPANSION)} * {_group_sql('x', N.MEANS_CONTENT)}
      + (content_type IN ('test_output','log','command_output') AND length(content) BETWEEN 1 AND 499)::INT) / 3 AS share FROM t)
  SELECT doc_id, share >= 0.3 AS value, floor(share * 100 + 0.5::DOUBLE) / 100 AS confidence FROM s""")
def should_retrieve_original(spark, sf):
    return N.analyze(_asked(spark, sf)).select("doc_id", "retrieve_original.value", "retrieve_original.confidence")


@query("analyzed_documents")
def analyzed_documents(spark, sf):
    return N.analyze(_asked(spark, sf)).select(
        "doc_id", "stats.*", F.array_join("actions", ",").alias("actions"),
        F.array_join("compress.reasons", ",").alias("compress_reasons"))


@query("high_retrieve_events", """
  SELECT 'fev_' || sha256('high_retrieve_count|' || scope_id || '|' || ccr_id) AS failure_id, ccr_id,
    'retrieved_' || retrieve_count || '_times' AS error_reason
  FROM t_ccr c WHERE retrieve_count >= 5 AND NOT EXISTS (SELECT 1 FROM t_fail f WHERE f.event_type = 'high_retrieve_count'
    AND f.scope_id = c.scope_id AND f.ccr_id = c.ccr_id)""")
def high_retrieve_events(spark, sf):
    events = N.high_retrieve_events(td.compressed(spark, sf), td.failures(spark, sf), td.NOW)
    return events.select("failure_id", "ccr_id", "error_reason")


def _chunk_sql(table: str, patterns: list[str], size: int, fallback: str, where: str = "true") -> str:
    """Greedy packing as a walk over running byte counts: each chunk starts where the last one ended."""
    marked = " ".join(
        f"WHEN len(list_filter(string_split(regexp_replace(content, '{p}', chr(1) || '\\1', 'g'), chr(1)), lambda x: octet_length(encode(x)) > {size})) = 0"
        f" THEN string_split(regexp_replace(content, '{p}', chr(1) || '\\1', 'g'), chr(1))" for p in patterns)
    return f"""
      WITH RECURSIVE d AS (SELECT doc_id, content, CASE WHEN octet_length(encode(content)) <= {size} THEN [content] {marked} ELSE {fallback} END AS parts
        FROM {table} WHERE {where}),
      p AS (SELECT doc_id, unnest(parts) AS part, unnest(generate_series(1, len(parts))) AS i, len(parts) AS n FROM d),
      r AS (SELECT *, CAST(sum(octet_length(encode(part))) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM p),
      w AS (SELECT doc_id, 0 AS chunk_index, 1::BIGINT AS start, 0::BIGINT AS base,
          coalesce(max(CASE WHEN upto <= {size} THEN i END), 1) AS stop FROM r GROUP BY doc_id
        UNION ALL SELECT w.doc_id, chunk_index + 1, w.stop + 1, b.upto,
          coalesce((SELECT max(i) FROM r WHERE r.doc_id = w.doc_id AND r.i > w.stop AND r.upto - b.upto <= {size}), w.stop + 1)
        FROM w JOIN r b ON b.doc_id = w.doc_id AND b.i = w.stop WHERE w.stop < b.n)
      SELECT w.doc_id, w.chunk_index, CAST(w.base AS BIGINT) AS byte_offset, CAST(sum(octet_length(encode(part))) AS BIGINT) AS byte_length,
        sha256(string_agg(part, '' ORDER BY i)) AS content_hash
      FROM w JOIN r ON r.doc_id = w.doc_id AND r.i BETWEEN w.start AND w.stop GROUP BY ALL"""


def _slices_sql(size: int, content: str = "content") -> str:
    """Slices of ``size`` bytes, every cut moved back to the start of a character."""
    h = f"hex(encode({content}))"
    n = f"octet_length(encode({content}))"

    def inside(p: str) -> str:
        return f"substr({h}, 2 * ({p}) + 1, 2) BETWEEN '80' AND 'BF'"

    def cut(p: str) -> str:
        return (f"(CASE WHEN {p} >= {n} THEN {n} WHEN NOT {inside(p)} THEN {p} WHEN NOT {inside(p + ' - 1')} THEN {p} - 1"
                f" WHEN NOT {inside(p + ' - 2')} THEN {p} - 2 ELSE {p} - 3 END)")

    a, b = cut(f"(i * {size})"), cut(f"((i + 1) * {size})")
    count = f"CAST(ceil({n} / {size}) AS BIGINT)"
    return f"list_transform(range({count}), lambda i: decode(unhex(substr({h}, 2 * {a} + 1, 2 * ({b} - {a})))))"


def _chunks(docs, max_tokens, kind):
    rows = C.chunk(docs, max_tokens, F.lit(kind))
    return rows.select("doc_id", "chunk_index", F.col("byte_offset").cast("bigint").alias("byte_offset"),
                       F.col("byte_length").cast("bigint").alias("byte_length"),
                       F.sha2("content", 256).alias("content_hash"))


@query("chunk_plain", _chunk_sql("t_corpus", [r"(\n\n)", r"(\n)"], 8000, _slices_sql(8000)))
def chunk_plain(spark, sf):
    return _chunks(td.corpus(spark, sf), 2000, "unknown")


@query("chunk_markdown", _chunk_sql("t_mddoc", [r"(\n## )", r"(\n# )", r"(\n### )", r"(\n\n)", r"(\n)"], 4000, _slices_sql(4000)))
def chunk_markdown(spark, sf):
    return _chunks(td.markdown_documents(spark, sf), 1000, "markdown")


_LOGDOC = "(SELECT scope_id, doc_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM t_logline GROUP BY ALL)"


@query("chunk_log", _chunk_sql(_LOGDOC, [r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})", r"(\n)"], 600, "[content]"))
def chunk_log(spark, sf):
    return _chunks(td.as_documents(td.log_lines(spark, sf)), 150, "log")


@query("chunk_bytes", f"""
  WITH d AS (SELECT doc_id, replace(content, chr(10), ' ') AS content FROM t_corpus),
  p AS (SELECT doc_id, CASE WHEN octet_length(encode(content)) <= 1000 THEN [content] ELSE {_slices_sql(1000)} END AS parts FROM d),
  u AS (SELECT doc_id, unnest(parts) AS part, unnest(generate_series(0, len(parts) - 1)) AS i FROM p)
  SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, octet_length(encode(part)) AS byte_length, sha256(part) AS content_hash,
    CAST(coalesce(sum(octet_length(encode(part))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset
  FROM u""")
def chunk_bytes(spark, sf):
    """Every document without its newlines, so that only byte slices fit."""
    docs = td.corpus(spark, sf).withColumn("content", F.regexp_replace("content", "\n", " "))
    return _chunks(docs, 250, "unknown")


@query("chunk_code")
def chunk_code(spark, sf):
    return _chunks(td.as_documents(td.code_lines(spark, sf)), 100, "code")


@query("chunked_corpus")
def chunked_corpus(spark, sf):
    rows = C.chunk(td.typed_corpus(spark, sf), 250)
    return rows.groupBy("content_type").agg(F.count(F.lit(1)).alias("chunks"), F.max("byte_length").alias("largest"))
