"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import normalize_sql, query, tokens_sql, trim_sql
from corpusmill.functions import text as T
from corpusmill.functions.values import parse_json, type_name
from corpusmill.operators.lines import sample_lines
from corpusmill.sources import testdata as td


@query("token_budget", f"""
  SELECT doc_id, {tokens_sql('content')} AS tokens, sha256(left(content, 400)) AS prefix_hash,
    {tokens_sql('left(content, 400)')} AS prefix_tokens FROM t_corpus""")
def token_budget(spark, sf):
    prefix = T.truncate_to_tokens(F.col("content"), 100)
    return td.corpus(spark, sf).select(
        "doc_id", T.token_count(F.col("content")).alias("tokens"),
        F.sha2(prefix, 256).alias("prefix_hash"), T.token_count(prefix).alias("prefix_tokens"))


@query("saved_and_ratio", "SELECT ccr_id, tokens_saved, compression_ratio FROM t_ccr")
def saved_and_ratio(spark, sf):
    c = td.compressed(spark, sf).select("ccr_id", "tokens_before", "tokens_after")
    c = c.withColumn("tokens_saved", T.tokens_saved(F.col("tokens_before"), F.col("tokens_after")))
    return c.select("ccr_id", "tokens_saved",
                    T.compression_ratio(F.col("tokens_before"), F.col("tokens_saved")).alias("compression_ratio"))


@query("content_hashes", """
  SELECT doc_id, sha256(content) AS full_hash, left(sha256(content), 8) AS short_hash FROM t_corpus""")
def content_hashes(spark, sf):
    c = F.col("content")
    return td.corpus(spark, sf).select(
        "doc_id", T.content_hash(c).alias("full_hash"), T.short_hash(c).alias("short_hash"))


@query("cache_keys", """
  SELECT doc_id,
    'cache_' || sha256(scope_id || '::' || sha256(content) || '::plain_text::1.0.0::2000::1') AS cache_key,
    'cache_' || sha256(scope_id || '::' || sha256(content || chr(10) || chr(0) || 'goal:' || scope_id)
      || '::plain_text::1.0.0::2000::0') AS goal_key
  FROM t_corpus""")
def cache_keys(spark, sf):
    args = (F.col("scope_id"), F.col("content"), F.lit("plain_text"), F.lit("1.0.0"), F.lit(2000))
    return td.corpus(spark, sf).select(
        "doc_id", T.cache_key(*args, F.lit(True)).alias("cache_key"),
        T.cache_key(*args, F.lit(False), F.col("scope_id")).alias("goal_key"))


@query("normalized_fingerprints", f"""
  SELECT memory_id, sha256({normalize_sql('content')}) AS normalized_hash,
    sha256(scope_id || '|' || type || '|' || {normalize_sql('content')}) AS fingerprint FROM t_mem""")
def normalized_fingerprints(spark, sf):
    c = F.col("content")
    return td.memories(spark, sf).select(
        "memory_id", F.sha2(T.normalize_memory(c), 256).alias("normalized_hash"),
        T.fingerprint(F.col("scope_id"), F.col("type"), c).alias("fingerprint"))


@query("section_keys", f"""
  SELECT doc_id, line_no, sha256(regexp_replace(lower({trim_sql('line')}), '\\s+', ' ', 'g')) AS key_hash
  FROM (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS line_no, unnest(ls) AS line
        FROM (SELECT doc_id, string_split(content, chr(10)) AS ls FROM t_corpus))""")
def section_keys(spark, sf):
    lines = td.corpus(spark, sf).select(
        "doc_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"),
                        F.sha2(T.section_key(F.col("line")), 256).alias("key_hash"))


@query("source_refs", """
  SELECT memory_id, split_part(source_ref, ':', 1) AS prefix,
    substr(source_ref, instr(source_ref, ':') + 1) AS value, 'unknown' AS other_prefix,
    'note:' || memory_id AS other_value
  FROM t_mem""")
def source_refs(spark, sf):
    parsed = T.parse_source_ref(F.col("source_ref"))
    other = T.parse_source_ref(F.concat(F.lit(" note:"), F.col("memory_id"), F.lit("\n")))
    return td.memories(spark, sf).select(
        "memory_id", parsed["prefix"].alias("prefix"), parsed["value"].alias("value"),
        other["prefix"].alias("other_prefix"), other["value"].alias("other_value"))


@query("normalized_titles", f"""
  SELECT doc_id, {trim_sql('''regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('Module #' || doc_id || ' ' || content), '`', '', 'g'),
    '\\b(component|module|package|service)\\s*[#:]?\\s*\\d+\\b', '\\1', 'g'), '\\d+', '#', 'g'),
    '[^a-z0-9\\x{4e00}-\\x{9fff}#]+', ' ', 'g')''')} AS title
  FROM t_corpus""")
def normalized_titles(spark, sf):
    title = F.concat(F.lit("Module #"), F.col("doc_id"), F.lit(" "), "content")
    return td.corpus(spark, sf).select("doc_id", T.normalize_title(title).alias("title"))


@query("expiry_and_dates", """
  SELECT memory_id, coalesce(expires_at < TIMESTAMP '2024-02-01', false) AS expired,
    CAST(created_at + INTERVAL 30 DAY AS VARCHAR) AS in_30_days FROM t_mem""")
def expiry_and_dates(spark, sf):
    now = F.lit(td.NOW).cast("timestamp_ntz")
    return td.memories(spark, sf).select(
        "memory_id", T.is_expired(F.col("expires_at"), now).alias("expired"),
        T.add_days(F.col("created_at"), 30).cast("string").alias("in_30_days"))


@query("size_guard", """
  SELECT doc_id, b AS original_bytes, least(b, 1000) AS resulting_bytes,
    CASE WHEN b <= 1000 THEN 'size_ok' ELSE 'size_truncated' END AS code,
    CASE WHEN b <= 1000 THEN 'size_ok' ELSE 'size_rejected' END AS strict_code,
    sha256(CASE WHEN b <= 1000 THEN content ELSE
      (SELECT left(content, max(i)) FROM generate_series(1000 // 4, 1000) s(i)
       WHERE octet_length(encode(left(content, i))) <= 1000) END) AS content_hash
  FROM (SELECT *, octet_length(encode(content)) AS b FROM t_corpus)""")
def size_guard(spark, sf):
    open_, strict = T.size_guard(F.col("content"), 1000), T.size_guard(F.col("content"), 1000, False)
    return td.corpus(spark, sf).select("doc_id", open_.alias("g"), strict.alias("s")).select(
        "doc_id", "g.original_bytes", "g.resulting_bytes", "g.code",
        F.col("s.code").alias("strict_code"), F.sha2("g.content", 256).alias("content_hash"))


@query("json_type_names", """
  SELECT event_id, 'object' AS whole, 'number' AS k, 'array<object>' AS listed, 'null' AS broken FROM events""")
def json_type_names(spark, sf):
    v = F.col("v")
    events = td.table(spark, sf, "events").withColumn("v", parse_json(F.col("props")))
    return events.select(
        "event_id", type_name(v).alias("whole"),
        type_name(F.try_variant_get(v, "$.k", "variant")).alias("k"),
        type_name(parse_json(F.concat(F.lit("["), "props", F.lit("]")))).alias("listed"),
        type_name(parse_json(F.concat("props", F.lit(" x")))).alias("broken"))


def _tenths_sql(n, d):
    r = f"((CAST({n} / {d} * 4503599627370496.0::DOUBLE AS HUGEINT) * 10 + 2251799813685248) // 4503599627370496)"
    return f"({r} // 10) || '.' || ({r} % 10)"


@query("readable_sizes", f"""
  SELECT doc_id, CASE WHEN n >= 1048576 THEN {_tenths_sql('n', '1048576')} || 'MB' WHEN n >= 1024
      THEN {_tenths_sql('n', '1024')} || 'KB' ELSE n || 'B' END AS size,
    CASE WHEN n >= 1000000 THEN {_tenths_sql('n', '1000000')} || 'M' WHEN n >= 1000
      THEN {_tenths_sql('n', '1000')} || 'K' ELSE CAST(n AS VARCHAR) END AS tokens
  FROM (SELECT doc_id, length(content) * (1 + doc_id % 200) AS n FROM t_corpus)""")
def readable_sizes(spark, sf):
    n = F.length("content").cast("bigint") * (F.lit(1) + F.col("doc_id") % 200)
    return td.corpus(spark, sf).select(
        "doc_id", T.format_bytes(n).alias("size"), T.format_tokens(n).alias("tokens"))


@query("sampled_lines", """
  WITH l AS (SELECT doc_id, string_split(content, chr(10)) AS ls, len(string_split(content, chr(10))) AS n FROM t_corpus),
  p AS (SELECT *, greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) AS k FROM l),
  q AS (SELECT *, n // 2 - k // 2 AS m FROM p)
  SELECT doc_id, sha256(array_to_string(list_concat(
      ls[1:k],
      [chr(10) || '// ... [sampled: middle section, lines ' || greatest(0, m) || '-' ||
        (greatest(0, m) + len(ls[greatest(0, m) + 1 : least(n, m + k)])) || '] ...' || chr(10)],
      list_filter(ls, lambda x, i: i > k AND i > greatest(0, m) AND i <= least(n, m + k)),
      [chr(10) || '// ... [sampled: tail section, lines ' || greatest(0, n - k) || '-' || n || '] ...' || chr(10)],
      list_filter(ls, lambda x, i: i > k AND i > n - k AND NOT (i > greatest(0, m) AND i <= least(n, m + k)))), chr(10))) AS sample_hash
  FROM q""")
def sampled_lines(spark, sf):
    sample = sample_lines(F.col("content"), 0.2)
    return td.corpus(spark, sf).select("doc_id", F.sha2(sample, 256).alias("sample_hash"))


@query("stripped_escapes", """
  SELECT doc_id, sha256(regexp_replace(content, '\\r\\n?', chr(10), 'g')) AS content_hash FROM t_corpus""")
def stripped_escapes(spark, sf):
    colored = F.concat(F.lit("\x1b[31m"), F.col("content"), F.lit("\x1b[0m"))
    return td.corpus(spark, sf).select(
        "doc_id", F.sha2(T.strip_ansi(colored), 256).alias("content_hash"))


@query("ordered_terms", """
  WITH t AS (SELECT query_id, list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x != '') AS terms FROM t_query),
  u AS (SELECT query_id, unnest(terms) AS term, unnest(generate_series(1, len(terms))) AS i FROM t),
  f AS (SELECT query_id, lower(term) AS k, min(i) AS i, arg_min(term, i) AS term FROM u GROUP BY ALL)
  SELECT query_id, string_agg(term, ' ' ORDER BY i) AS terms FROM f GROUP BY query_id""")
def ordered_terms(spark, sf):
    terms = T.ordered_distinct(F.split("query", r"\s+"))
    return td.recall_queries(spark, sf).select("query_id", F.array_join(terms, " ").alias("terms"))


@query("clean_metadata", """
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
    event_id % 2 = 1 AS emptied FROM events""")
def clean_metadata(spark, sf):
    internal = F.create_map(F.lit("_chunkIndex"), F.lit("1"), F.lit("_chunkTotal"), F.lit("2"))
    props = F.from_json("props", "map<string,string>")
    meta = F.when(F.col("event_id") % 2 == 0, F.map_concat(internal, props)).otherwise(internal)
    clean = T.strip_internal_keys(meta)
    return td.table(spark, sf, "events").select(
        "event_id", clean["k"].cast("bigint").alias("k"), clean.isNull().alias("emptied"))
