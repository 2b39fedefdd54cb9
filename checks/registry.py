"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return add


_NOW = "TIMESTAMP '2024-02-01 00:00:00'"
_TYPES = (
    "['test_output','log','command_output','code','json','markdown','plain_text','rag_chunk',"
    "'file_summary','conversation_history','unknown']"
)
_MEM_TYPES = (
    "['decision','bug','command','file_summary','project_rule','user_preference','current_task',"
    "'test_failure','api_contract','dependency']"
)
_WS = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)||chr(5760)||chr(8192)||chr(8193)"
    "||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)"
    "||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)||chr(65279)"
)


def trim_sql(c: str) -> str:
    return f"trim({c}, {_WS})"


def tokens_sql(c: str) -> str:
    return f"CAST(ceil(length({c}) / 4) AS BIGINT)"


def normalize_sql(c: str) -> str:
    unix = f"regexp_replace({trim_sql(c)}, '\\r\\n?', chr(10), 'g')"
    return f"regexp_replace({unix}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def round_sql(c: str, digits: int) -> str:
    return f"floor(CAST({c} AS DOUBLE) * {10**digits}.0::DOUBLE + 0.5::DOUBLE) / {10**digits}.0::DOUBLE"


# The adapters of corpusmill.sources.testdata, written again in SQL.
TABLES: dict[str, str] = {
    "t_corpus": "SELECT source AS scope_id, doc_id, text AS content FROM documents",
    "t_pages": (
        "SELECT 'src' || (page_id % 20) AS scope_id, page_id AS doc_id, html AS content FROM pages"
    ),
    "t_orig": f"""
        SELECT 'orig_' || doc_id AS original_id, source AS scope_id,
          'ccr_' || (doc_id - doc_id % 2) AS ccr_id,
          ({_TYPES})[doc_id % 11 + 1] AS content_type, text AS content,
          sha256(text) AS content_hash, {tokens_sql('text')} AS tokens,
          {_NOW} - to_minutes(doc_id % 100000) AS created_at,
          CASE WHEN doc_id % 3 = 0 THEN {_NOW} - to_minutes((doc_id % 7 - 3) * 1440) END AS expires_at
        FROM documents""",
    "t_ccr": f"""
        SELECT *, greatest(0, tokens_before - tokens_after) AS tokens_saved,
          CASE WHEN tokens_before > 0 THEN
            {round_sql('greatest(0, tokens_before - tokens_after) / tokens_before', 4)}
            ELSE 0.0::DOUBLE END AS compression_ratio
        FROM (SELECT *, tokens_before - CAST(floor(tokens_before * (doc_id % 10) / 10) AS BIGINT) AS tokens_after
        FROM (SELECT doc_id, 'ccr_' || doc_id AS ccr_id, source AS scope_id,
          ({_TYPES})[doc_id % 11 + 1] AS content_type,
          CASE WHEN doc_id % 4 != 0 THEN left(text, 60) END AS summary,
          'orig_' || doc_id AS original_ref,
          CASE WHEN doc_id % 5 = 0 THEN 'user:manual' WHEN doc_id % 5 = 1 THEN 'file:doc_' || (doc_id % 100)
            ELSE 'orig:orig_' || doc_id END AS source_ref,
          {tokens_sql('text')} AS tokens_before,
          doc_id % 3 != 1 AS can_retrieve_original, doc_id % 8 AS retrieve_count,
          doc_id % 13 = 0 AS failed,
          {_NOW} - to_minutes(doc_id % 100000) AS created_at,
          sha256(text) AS content_hash,
          CASE WHEN doc_id % 3 != 0 THEN 'cache_' || sha256(text || '::' || doc_id) END AS cache_key,
          doc_id % 7 AS cache_hit_count,
          CASE WHEN doc_id % 4 != 0 THEN {_NOW} - to_minutes(doc_id % 1000) END AS last_accessed_at
        FROM documents))""",
    "t_mem": f"""
        SELECT *, CASE WHEN doc_id % 5 != 0 THEN
            sha256(scope_id || '|' || type || '|' || {normalize_sql('content')}) END AS fingerprint
        FROM (SELECT d.doc_id, 'mem_' || d.doc_id AS memory_id, source AS scope_id,
          ({_MEM_TYPES})[d.doc_id % 10 + 1] AS type, text AS content,
          CASE WHEN d.doc_id % 3 != 0 THEN left(text, 80) END AS summary,
          CASE d.doc_id % 4 WHEN 0 THEN 'ccr:ccr_' || d.doc_id WHEN 1 THEN 'orig:orig_' || d.doc_id
            WHEN 2 THEN 'file:doc_' || (d.doc_id % 100) ELSE 'user:manual' END AS source_ref,
          CASE quality WHEN 1 THEN 0.9::DOUBLE WHEN 0 THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS confidence,
          CASE d.doc_id % 10 WHEN 7 THEN 'superseded' WHEN 8 THEN 'forgotten' WHEN 9 THEN 'expired'
            ELSE 'active' END AS status,
          {_NOW} - to_minutes((d.doc_id % 3650) * 1440) AS created_at,
          CASE WHEN d.doc_id % 6 = 0 THEN {_NOW} - to_minutes((d.doc_id % 61 - 30) * 1440) END AS expires_at,
          CASE WHEN d.doc_id % 10 = 7 THEN 'mem_' || (d.doc_id - d.doc_id % 100 + d.doc_id % 20) END AS superseded_by,
          'tag_' || (d.doc_id % 9) AS tag
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "t_fact": f"""
        SELECT *, created_at + to_minutes(doc_id % 60) AS updated_at
        FROM (SELECT doc_id, 'pf_' || doc_id AS fact_id, source AS scope_id,
          CASE WHEN doc_id % 2 = 0 THEN 'static' ELSE 'dynamic' END AS layer,
          left(text, 80) AS content, 'mem_' || doc_id AS source_memory_id,
          0.5::DOUBLE + (doc_id % 5)::DOUBLE / 10 AS confidence,
          {_NOW} - to_minutes(doc_id % 5000) AS created_at,
          CASE WHEN doc_id % 3 = 0 THEN {_NOW} - to_minutes((doc_id % 9 - 4) * 60) END AS expires_at
        FROM documents)""",
    "t_rcp": f"""
        SELECT *, greatest(0, tokens_before - tokens_after) AS tokens_saved,
          CASE WHEN tokens_before > 0 THEN
            {round_sql('greatest(0, tokens_before - tokens_after) / tokens_before', 4)}
            ELSE 0.0::DOUBLE END AS compression_ratio
        FROM (SELECT *, CAST(floor(tokens_before * k / 100) AS BIGINT) AS tokens_after
        FROM (SELECT event_id, 'rcp_' || event_id AS receipt_id,
          CASE event_type WHEN 'purchase' THEN 'compress' WHEN 'click' THEN 'recall'
            WHEN 'view' THEN 'retrieve_original' WHEN 'signup' THEN 'remember' ELSE 'forget' END AS operation,
          'src' || (user_id % 20) AS scope_id,
          CASE WHEN event_type = 'click' THEN ['mem_' || (event_id % 200), 'mem_' || (event_id * 3 % 200),
            'mem_' || (event_id * 7 % 200)] END AS memory_ids,
          CASE WHEN event_type IN ('purchase','view') THEN 'ccr_' || (event_id % 200) END AS ccr_id,
          CASE WHEN event_type = 'view' THEN 'orig_' || (event_id % 200) END AS original_ref,
          CAST(floor(value * 100) AS BIGINT) AS tokens_before,
          CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
          event_id % 17 = 0 AS failed, event_id % 5 = 0 AS cache_hit, ts AS timestamp,
          'run_' || CAST(floor(event_id / 100) AS BIGINT) AS run_id
        FROM events))""",
    "t_fail": f"""
        SELECT 'fev_' || event_id AS failure_id, 'src' || (user_id % 20) AS scope_id,
          (['compress','recall','retrieve_original'])[event_id % 3 + 1] AS operation,
          ({_TYPES})[event_id % 11 + 1] AS content_type,
          CASE WHEN event_id % 4 != 0 THEN 'ccr_' || (user_id % 40) END AS ccr_id,
          (['compression_timeout','compression_error','oversized_input','poor_compression_ratio',
            'recall_no_hit','recall_low_confidence','recall_wrong_memory','high_retrieve_count'])[event_id % 8 + 1]
            AS event_type, ts AS created_at, props AS metadata
        FROM events WHERE event_type = 'error'""",
    "t_query": (
        "SELECT item_id AS query_id, 'src' || (item_id % 20) AS scope_id, text AS query FROM benchmark"
    ),
    "t_msg": "SELECT conv_id, turn, role, text AS content FROM conversations",
    "t_dir": """
        SELECT '/work/' || page_id AS cwd,
          CASE WHEN page_id % 3 != 2 THEN '/work/root_' || (page_id % 50) END AS git_root,
          CASE WHEN page_id % 3 = 0 THEN url END AS remote, 'main' AS branch FROM pages""",
    "t_ev": """
        SELECT event_id AS e, event_id % 50 AS i, user_id AS u, event_type AS kind,
          CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
          strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at_text, event_id // 50 AS doc_id,
          'src' || (event_id // 50 % 20) AS scope_id, CAST(event_id % 50 AS INTEGER) AS line_no FROM events""",
    "t_logline": """
        SELECT scope_id, doc_id, line_no, CASE
          WHEN kind = 'error' THEN at_text || ' ERROR [user-' || u || '] PaymentError: request failed request_id=req-' || (u % 7)
            || ' at src/user' || (u % 5) || '.ts:' || k
          WHEN kind = 'view' THEN at_text || ' INFO [user-' || u || '] page viewed'
          WHEN kind = 'click' THEN at_text || ' DEBUG clicked'
          WHEN kind = 'signup' THEN '    at handler (src/user' || (u % 5) || '.ts:12:' || k || ')'
          WHEN e % 3 = 0 THEN at_text || ' heartbeat ok' WHEN e % 3 = 1 THEN ''
          ELSE at_text || ' WARN slow purchase' END AS line FROM t_ev""",
    "t_testline": """
        SELECT scope_id, doc_id, line_no, CASE WHEN i = 0 THEN '> vitest run suite' || doc_id
          WHEN i = 1 THEN ' RUN  vitest v1.2.3' WHEN i = 2 THEN ' FAIL  src/user' || u || '.test.ts'
          WHEN i = 49 THEN CASE WHEN e % 150 = 49 THEN 'exit code: 1' ELSE 'Test Suites: done' END
          WHEN i % 10 = 3 THEN '   × test ' || e || ' fails' WHEN i % 10 = 4 THEN 'AssertionError: value ' || k
          WHEN i % 10 = 5 THEN 'Expected: ' || k WHEN i % 10 = 6 THEN 'Received: ' || (k + 1)
          WHEN i % 10 = 7 THEN '    at src/user' || u || '.ts:' || (k + 1) || ':5'
          ELSE '   ✓ test ' || e || ' passes' END AS line FROM t_ev""",
    "t_cmdline": """
        SELECT scope_id, doc_id, line_no, CASE WHEN i = 0 THEN '$ npm run build' WHEN i = 1 THEN 'npm install package-' || k
          WHEN i = 48 THEN 'Build failed with errors' WHEN i = 49 THEN 'Command failed with exit code ' || (k % 3)
          WHEN i % 5 = 2 THEN 'src/user' || (u % 9) || '.ts(' || k || ',5): error TS' || (k % 3 + 2300)
            || ': Cannot find name ''user' || (u % 9) || ''''
          WHEN i % 5 = 3 THEN '[====>   ] ' || k || '%' WHEN i % 5 = 4 THEN 'stderr: warning ' || e
          ELSE 'compiled module ' || e END AS line FROM t_ev""",
    "t_codeline": """
        SELECT 'src' || (p // 40 % 20) AS scope_id, p // 40 AS doc_id, CAST(i AS INTEGER) AS line_no, CASE
          WHEN i = 0 THEN 'import { a' || p || ' } from "./m' || p || '";'
          WHEN i = 1 THEN 'export const LIMIT_' || p || ' = ' || p_size || ';' WHEN i = 2 THEN '// TODO: review ' || p_name
          WHEN i = 3 THEN 'export interface Part' || p || ' {' WHEN i = 4 THEN '  name: string;'
          WHEN i = 6 THEN 'export class Shop' || p || ' extends Base {' WHEN i = 7 THEN '  public price(q: number): number {'
          WHEN i = 8 THEN '    return q * ' || p_size || ';' WHEN i IN (9, 12) THEN '  }' WHEN i = 10 THEN '  private hidden() {'
          WHEN i = 11 THEN '    return 1;' WHEN i IN (5, 13) THEN '}' WHEN i = 14 THEN 'type Id' || p || ' = string;'
          WHEN i = 15 THEN '' WHEN i % 4 = 0 THEN 'export function part_' || p || '(a: number): number {'
          WHEN i % 4 = 1 THEN '  const x = a + ' || p_size || ';'
          WHEN i % 4 = 2 AND p % 3 = 0 THEN '  if (x < 0) { throw new Error(''' || p_name || '''); }'
          WHEN i % 4 = 2 THEN '  return x;' ELSE '}' END AS line
        FROM (SELECT p_partkey AS p, p_partkey % 40 AS i, p_size, p_name FROM part)""",
    "t_jsondoc": """
        SELECT 'src' || (e % 20) AS scope_id, e AS doc_id, '{"id":' || e || ',"status":"' || kind || '","user":{"userId":' || u
          || ',"errorCode":"E' || k || '"},"items":[1,2,3,4,5,6,' || k || '],"rows":[{"id":' || k || ',"code":"c1"},{"id":' || k
          || ',"code":"c2"}],"note":"' || repeat('word ', CAST(k % 50 + 20 AS INTEGER)) || '"}' AS content FROM t_ev""",
    "t_mddoc": """
        SELECT source AS scope_id, doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
          (CASE WHEN (i - 1) % 5 = 4 THEN '## Rollback plan ' WHEN (i - 1) % 3 = 0 THEN '## Component ' ELSE '### Topic ' END)
          || ((i - 1) % 7) || chr(10) || chr(10) || line || chr(10) || '- timeout: ' || (doc_id % 9) || ' ms'),
          chr(10) || chr(10)) AS content FROM documents""",
    "t_ragdoc": """
        SELECT source AS scope_id, doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
          'source: file_' || ((i - 1) % 4) || chr(10) || 'title: Title ' || doc_id || chr(10) || 'chunk_id: c_' || (i - 1)
          || chr(10) || 'score: 0.' || (((i - 1) * 37 + doc_id) % 90 + 10) || chr(10) || line), chr(10)) AS content FROM documents""",
    "t_convdoc": """
        SELECT 'src' || (conv_id % 20) AS scope_id, conv_id * 1000000 + turn // 64 AS doc_id,
          string_agg('<' || role || '>' || chr(10) || role || ': ' || text, chr(10) ORDER BY turn) AS content
        FROM conversations GROUP BY ALL""",
    "t_typed": """
        SELECT scope_id, kind || '_' || doc_id AS doc_id, kind AS content_type, content FROM (
          SELECT 'log' AS kind, scope_id, doc_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM t_logline GROUP BY ALL
          UNION ALL SELECT 'test_output', scope_id, doc_id, string_agg(line, chr(10) ORDER BY line_no) FROM t_testline GROUP BY ALL
          UNION ALL SELECT 'command_output', scope_id, doc_id, string_agg(line, chr(10) ORDER BY line_no) FROM t_cmdline GROUP BY ALL
          UNION ALL SELECT 'code', scope_id, doc_id, string_agg(line, chr(10) ORDER BY line_no) FROM t_codeline GROUP BY ALL
          UNION ALL SELECT 'json', scope_id, doc_id, content FROM t_jsondoc
          UNION ALL SELECT 'markdown', scope_id, doc_id, content FROM t_mddoc
          UNION ALL SELECT 'rag_chunk', scope_id, doc_id, content FROM t_ragdoc
          UNION ALL SELECT 'conversation_history', scope_id, doc_id, content FROM t_convdoc
          UNION ALL SELECT 'plain_text', scope_id, doc_id, content FROM t_corpus)""",
}


def with_tables(sql: str) -> str:
    """Prepend the adapter tables that the statement needs, in dependency order."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name, body in TABLES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(body)

    need(sql)
    used = [f"{name} AS ({body})" for name, body in TABLES.items() if name in needed]
    if not used:
        return sql
    head = ", ".join(used)
    stripped = sql.lstrip()
    if stripped[:15].upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {stripped[15:]}"
    if stripped[:5].upper() == "WITH ":
        return f"WITH {head}, {stripped[5:]}"
    return f"WITH {head} {stripped}"
