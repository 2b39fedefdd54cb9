"""Adapter: the driver's generic tables as engine tables.

Everything is a row-wise projection of one input row (labels and sampled
turns excepted), so each derived table grows with its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.schemas import CONTENT_TYPES, FAILURE_OPERATIONS, FAILURE_TYPES, MEMORY_TYPES

NOW = "2024-02-01 00:00:00"
SCOPE_COUNT = 20
LINKED_DOCS = 200  # ids that every scale factor has, so that references resolve


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tasks(df: DataFrame) -> int:
    """So many tasks that every core has several."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt out before long texts are made of them.

    A file of narrow rows is few tasks, and Spark joins small shuffled parts
    into few again; what follows works on texts many times as large.
    """
    return rows.repartition(_tasks(rows), *keys)


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _minutes_before(minutes: Column) -> Column:
    return _now() - F.make_interval(mins=minutes.cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("scope_id"), "doc_id", F.col("text").alias("content")
    )


def page_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("src"), F.col("page_id") % SCOPE_COUNT).alias("scope_id"),
        F.col("page_id").alias("doc_id"),
        F.col("html").alias("content"),
    )


def originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("orig_"), d).alias("original_id"),
        F.col("source").alias("scope_id"),
        F.concat(F.lit("ccr_"), d - d % 2).alias("ccr_id"),
        _pick(CONTENT_TYPES, d % len(CONTENT_TYPES)).alias("content_type"),
        F.col("text").alias("content"),
        T.content_hash(F.col("text")).alias("content_hash"),
        T.token_count(F.col("text")).alias("tokens"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        _minutes_before(d % 100_000).alias("created_at"),
        F.when(d % 3 == 0, _minutes_before((d % 7 - 3) * 1440)).alias("expires_at"),
    )


def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("scope_id"), "text",
        T.token_count(F.col("text")).alias("tokens_before"),
    )
    after = F.col("tokens_before") - F.floor(F.col("tokens_before") * (d % 10) / 10)
    docs = docs.withColumn("tokens_after", after)
    docs = docs.withColumn(
        "tokens_saved", T.tokens_saved(F.col("tokens_before"), F.col("tokens_after"))
    )
    ref = (
        F.when(d % 5 == 0, F.lit("user:manual"))
        .when(d % 5 == 1, F.concat(F.lit("file:doc_"), d % 100))
        .otherwise(F.concat(F.lit("orig:orig_"), d))
    )
    return docs.select(
        F.concat(F.lit("ccr_"), d).alias("ccr_id"),
        "scope_id",
        _pick(CONTENT_TYPES, d % len(CONTENT_TYPES)).alias("content_type"),
        F.concat(
            _pick(CONTENT_TYPES, d % len(CONTENT_TYPES)), F.lit("_conservative_v1")
        ).alias("strategy"),
        T.truncate_to_tokens(F.col("text"), F.col("tokens_after")).alias("compressed_content"),
        F.when(d % 4 != 0, F.substring("text", 1, 60)).alias("summary"),
        F.concat(F.lit("orig_"), d).alias("original_ref"),
        ref.alias("source_ref"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        "tokens_before",
        "tokens_after",
        "tokens_saved",
        T.compression_ratio(F.col("tokens_before"), F.col("tokens_saved")).alias(
            "compression_ratio"
        ),
        (d % 3 != 1).alias("can_retrieve_original"),
        (d % 8).alias("retrieve_count"),
        (d % 13 == 0).alias("failed"),
        F.when(d % 13 == 0, F.lit("compression_failed")).alias("error_reason"),
        _minutes_before(d % 100_000).alias("created_at"),
        _minutes_before(d % 100_000).alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("expires_at"),
        T.content_hash(F.col("text")).alias("content_hash"),
        F.when(
            d % 3 != 0, F.concat(F.lit("cache_"), F.sha2(F.concat("text", F.lit("::"), d), 256))
        ).alias("cache_key"),
        F.lit("1.0.0").alias("strategy_version"),
        (d % 7).alias("cache_hit_count"),
        F.when(d % 4 != 0, _minutes_before(d % 1000)).alias("last_accessed_at"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = F.col("doc_id")
    memory_type = _pick(MEMORY_TYPES, d % len(MEMORY_TYPES))
    status = (
        F.when(d % 10 == 7, "superseded")
        .when(d % 10 == 8, "forgotten")
        .when(d % 10 == 9, "expired")
        .otherwise("active")
    )
    ref = (
        F.when(d % 4 == 0, F.concat(F.lit("ccr:ccr_"), d))
        .when(d % 4 == 1, F.concat(F.lit("orig:orig_"), d))
        .when(d % 4 == 2, F.concat(F.lit("file:doc_"), d % 100))
        .otherwise("user:manual")
    )
    created = _minutes_before((d % 3650) * 1440)
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("mem_"), d).alias("memory_id"),
        F.col("source").alias("scope_id"),
        memory_type.alias("type"),
        F.col("text").alias("content"),
        F.when(d % 3 != 0, F.substring("text", 1, 80)).alias("summary"),
        ref.alias("source_ref"),
        F.when(F.col("quality") == 1, 0.9)
        .when(F.col("quality") == 0, 0.4)
        .otherwise(0.8)
        .alias("confidence"),
        status.alias("status"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.when(d % 6 == 0, _minutes_before((d % 61 - 30) * 1440)).alias("expires_at"),
        F.when(d % 10 == 7, F.concat(F.lit("mem_"), d - d % 100 + d % 20)).alias("superseded_by"),
        F.array(F.concat(F.lit("tag_"), d % 9)).alias("tags"),
        F.when(d % 5 != 0, T.fingerprint(F.col("source"), memory_type, F.col("text"))).alias(
            "fingerprint"
        ),
    )


def profile_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    created = _minutes_before(d % 5000)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("pf_"), d).alias("fact_id"),
        F.col("source").alias("scope_id"),
        F.when(d % 2 == 0, "static").otherwise("dynamic").alias("layer"),
        F.substring("text", 1, 80).alias("content"),
        F.concat(F.lit("mem_"), d).alias("source_memory_id"),
        F.lit("user:manual").alias("source_ref"),
        (F.lit(0.5) + (d % 5).cast("double") / 10).alias("confidence"),
        created.alias("created_at"),
        (created + F.make_interval(mins=(d % 60).cast("int"))).alias("updated_at"),
        F.when(d % 3 == 0, _minutes_before((d % 9 - 4) * 60)).alias("expires_at"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts_from(table(spark, sf_dir, "events"))


def receipts_from(events: DataFrame) -> DataFrame:
    """Receipts of an event table or an event stream."""
    e = F.col("event_id")
    operation = (
        F.when(F.col("event_type") == "purchase", "compress")
        .when(F.col("event_type") == "click", "recall")
        .when(F.col("event_type") == "view", "retrieve_original")
        .when(F.col("event_type") == "signup", "remember")
        .otherwise("forget")
    )
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = events.select(
        "event_id", "ts", "user_id", operation.alias("operation"),
        F.floor(F.col("value") * 100).alias("tokens_before"), k.alias("k"),
    )
    base = base.withColumn("tokens_after", F.floor(F.col("tokens_before") * F.col("k") / 100))
    base = base.withColumn(
        "tokens_saved", T.tokens_saved(F.col("tokens_before"), F.col("tokens_after"))
    )
    op = F.col("operation")

    def ids(prefix: str, *steps: int) -> Column:
        return F.array(*[F.concat(F.lit(prefix), (e * s) % LINKED_DOCS) for s in steps])

    return base.select(
        F.concat(F.lit("rcp_"), e).alias("receipt_id"),
        "operation",
        F.concat(F.lit("src"), F.col("user_id") % SCOPE_COUNT).alias("scope_id"),
        F.lit(None).cast("string").alias("input_hash"),
        F.lit(None).cast("string").alias("query"),
        F.lit(None).cast("array<string>").alias("result_ids"),
        F.when(op == "recall", ids("mem_", 1, 3, 7)).alias("memory_ids"),
        F.when(op.isin("compress", "retrieve_original"), ids("ccr_", 1)).alias("ccr_ids"),
        F.when(op == "retrieve_original", ids("orig_", 1)).alias("original_refs"),
        "tokens_before",
        "tokens_after",
        "tokens_saved",
        T.compression_ratio(F.col("tokens_before"), F.col("tokens_saved")).alias(
            "compression_ratio"
        ),
        (op == "compress").alias("compressed"),
        (op == "retrieve_original").alias("retrieved_original"),
        (e % 17 == 0).alias("failed"),
        F.when(e % 17 == 0, F.lit("storage_error")).alias("error_reason"),
        (e % 5 == 0).alias("cache_hit"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("run_"), F.floor(e / 100)).alias("run_id"),
        F.lit(None).cast("string").alias("event_type"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures_from(table(spark, sf_dir, "events"))


def failures_from(events: DataFrame) -> DataFrame:
    """Failure events: the error rows of an event table or stream."""
    e = F.col("event_id")
    return events.filter(F.col("event_type") == "error").select(
        F.concat(F.lit("fev_"), e).alias("failure_id"),
        F.concat(F.lit("src"), F.col("user_id") % SCOPE_COUNT).alias("scope_id"),
        _pick(FAILURE_OPERATIONS, e % 3).alias("operation"),
        _pick(CONTENT_TYPES, e % len(CONTENT_TYPES)).alias("content_type"),
        F.lit(None).cast("string").alias("strategy"),
        F.when(e % 4 != 0, F.concat(F.lit("ccr_"), F.col("user_id") % 40)).alias("ccr_id"),
        F.lit(None).cast("string").alias("memory_id"),
        F.lit("reason").alias("error_reason"),
        _pick(FAILURE_TYPES, e % 8).alias("event_type"),
        F.col("ts").alias("created_at"),
        F.col("props").alias("metadata"),
    )


def recall_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), F.col("item_id") % SCOPE_COUNT).alias("scope_id"),
        F.col("text").alias("query"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text").alias("content")
    )


def working_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories to resolve scopes for: every third page without a remote."""
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/work/"), p).alias("cwd"),
        F.when(p % 3 != 2, F.concat(F.lit("/work/root_"), p % 50)).alias("git_root"),
        F.when(p % 3 == 0, F.col("url")).alias("remote"),
        F.lit("main").alias("branch"),
    )


# --- texts of the other content types, derived row by row from the tables ---
# A document of lines is a fixed range of ids, so it has a fixed largest size.

LINES_PER_DOC = 50


def _line_table(rows: DataFrame, row_id: str, per_doc: int, line: Column) -> DataFrame:
    doc_id = F.floor(F.col(row_id) / per_doc)
    return rows.select(
        F.concat(F.lit("src"), doc_id % SCOPE_COUNT).alias("scope_id"),
        doc_id.alias("doc_id"),
        (F.col(row_id) % per_doc).cast("int").alias("line_no"),
        line.alias("line"),
    )


def as_documents(line_table: DataFrame) -> DataFrame:
    """Join the lines of id-range documents back into texts."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    dealt = spread(line_table, "scope_id", "doc_id")
    grouped = dealt.groupBy("scope_id", "doc_id").agg(rows.alias("rows"))
    return grouped.select(
        "scope_id", "doc_id", F.array_join(F.col("rows.line"), "\n").alias("content")
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", k.alias("k"), at.alias("at")
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, user, k = F.col("at"), F.col("user_id"), F.col("k")
    kind, e = F.col("event_type"), F.col("event_id")
    line = (
        F.when(kind == "error", _text(
            at, " ERROR [user-", user, "] PaymentError: request failed request_id=req-", user % 7,
            " at src/user", user % 5, ".ts:", k))
        .when(kind == "view", _text(at, " INFO [user-", user, "] page viewed"))
        .when(kind == "click", _text(at, " DEBUG clicked"))
        .when(kind == "signup", _text("    at handler (src/user", user % 5, ".ts:12:", k, ")"))
        .when(e % 3 == 0, _text(at, " heartbeat ok"))
        .when(e % 3 == 1, F.lit(""))
        .otherwise(_text(at, " WARN slow purchase"))
    )
    return _line_table(_events(spark, sf_dir), "event_id", LINES_PER_DOC, line)


def test_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, k, e = F.col("user_id"), F.col("k"), F.col("event_id")
    i = e % LINES_PER_DOC
    line = (
        F.when(i == 0, _text("> vitest run suite", F.floor(e / LINES_PER_DOC)))
        .when(i == 1, F.lit(" RUN  vitest v1.2.3"))
        .when(i == 2, _text(" FAIL  src/user", user, ".test.ts"))
        .when(i == 49, F.when(e % 150 == 49, "exit code: 1").otherwise("Test Suites: done"))
        .when(i % 10 == 3, _text("   × test ", e, " fails"))
        .when(i % 10 == 4, _text("AssertionError: value ", k))
        .when(i % 10 == 5, _text("Expected: ", k))
        .when(i % 10 == 6, _text("Received: ", k + 1))
        .when(i % 10 == 7, _text("    at src/user", user, ".ts:", k + 1, ":5"))
        .otherwise(_text("   ✓ test ", e, " passes"))
    )
    return _line_table(_events(spark, sf_dir), "event_id", LINES_PER_DOC, line)


def command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, k, e = F.col("user_id"), F.col("k"), F.col("event_id")
    i = e % LINES_PER_DOC
    line = (
        F.when(i == 0, F.lit("$ npm run build"))
        .when(i == 1, _text("npm install package-", k))
        .when(i == 48, F.lit("Build failed with errors"))
        .when(i == 49, _text("Command failed with exit code ", k % 3))
        .when(i % 5 == 2, _text(
            "src/user", user % 9, ".ts(", k, ",5): error TS", k % 3 + 2300,
            ": Cannot find name 'user", user % 9, "'"))
        .when(i % 5 == 3, _text("[====>   ] ", k, "%"))
        .when(i % 5 == 4, _text("stderr: warning ", e))
        .otherwise(_text("compiled module ", e))
    )
    return _line_table(_events(spark, sf_dir), "event_id", LINES_PER_DOC, line)


CODE_LINES = 40


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    i = p % CODE_LINES
    line = (
        F.when(i == 0, _text("import { a", p, " } from \"./m", p, "\";"))
        .when(i == 1, _text("export const LIMIT_", p, " = ", size, ";"))
        .when(i == 2, _text("// TODO: review ", name))
        .when(i == 3, _text("export interface Part", p, " {"))
        .when(i == 4, F.lit("  name: string;"))
        .when(i == 6, _text("export class Shop", p, " extends Base {"))
        .when(i == 7, F.lit("  public price(q: number): number {"))
        .when(i == 8, _text("    return q * ", size, ";"))
        .when(i.isin(9, 12), F.lit("  }"))
        .when(i == 10, F.lit("  private hidden() {"))
        .when(i == 11, F.lit("    return 1;"))
        .when(i.isin(5, 13), F.lit("}"))
        .when(i == 14, _text("type Id", p, " = string;"))
        .when(i == 15, F.lit(""))
        .when(i % 4 == 0, _text("export function part_", p, "(a: number): number {"))
        .when(i % 4 == 1, _text("  const x = a + ", size, ";"))
        .when((i % 4 == 2) & (p % 3 == 0), _text("  if (x < 0) { throw new Error('", name, "'); }"))
        .when(i % 4 == 2, F.lit("  return x;"))
        .otherwise(F.lit("}"))
    )
    return _line_table(table(spark, sf_dir, "part"), "p_partkey", CODE_LINES, line)


def deep_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON text per document: an object of up to 40 levels and an item per line."""
    d = F.col("doc_id")
    levels = (d % 40).cast("int")
    items = F.transform(F.split("text", "\n"), lambda _line, i: _text(
        '{"code":"c', i, '","name":"same","part":{"parts":[{"statusOf":', i, "}]}}"))
    content = _text(
        '{"deep":', F.repeat(F.lit('{"l":'), levels), '{"errorCode":"E', d, '"}', F.repeat(F.lit("}"), levels),
        ',"items":[', F.array_join(items, ","), "]}")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("scope_id"), d.alias("doc_id"), content.alias("content"))


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("k")
    content = _text(
        '{"id":', e, ',"status":"', F.col("event_type"), '","user":{"userId":',
        F.col("user_id"), ',"errorCode":"E', k, '"},"items":[1,2,3,4,5,6,', k,
        '],"rows":[{"id":', k, ',"code":"c1"},{"id":', k, ',"code":"c2"}],"note":"',
        F.repeat(F.lit("word "), (k % 50 + 20).cast("int")), '"}',
    )
    return spread(_events(spark, sf_dir), "event_id").select(
        F.concat(F.lit("src"), e % SCOPE_COUNT).alias("scope_id"),
        e.alias("doc_id"),
        content.alias("content"),
    )


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document under a numbered heading."""
    d = F.col("doc_id")
    sections = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            F.when(i % 5 == 4, "## Rollback plan ").when(i % 3 == 0, "## Component ").otherwise(
                "### Topic "),
            (i % 7).cast("string"), F.lit("\n\n"), line, F.lit("\n- timeout: "),
            (d % 9).cast("string"), F.lit(" ms"),
        ),
    )
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("scope_id"), "doc_id", F.array_join(sections, "\n\n").alias("content")
    )


def rag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a retrieved passage."""
    d = F.col("doc_id")
    passages = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            F.lit("source: file_"), (i % 4).cast("string"), F.lit("\ntitle: Title "),
            d.cast("string"), F.lit("\nchunk_id: c_"), i.cast("string"), F.lit("\nscore: 0."),
            ((i * 37 + d) % 90 + 10).cast("string"), F.lit("\n"), line,
        ),
    )
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("scope_id"), "doc_id", F.array_join(passages, "\n").alias("content")
    )


TURNS_PER_DOC = 64


def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of at most 64 turns of a conversation as one text."""
    role = F.col("role")
    line = F.concat(F.lit("<"), role, F.lit(">\n"), role, F.lit(": "), F.col("text"))
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("src"), F.col("conv_id") % SCOPE_COUNT).alias("scope_id"),
        (F.col("conv_id") * 1_000_000 + F.floor(F.col("turn") / TURNS_PER_DOC)).alias("doc_id"),
        F.col("turn").alias("line_no"),
        line.alias("line"),
    )
    return as_documents(turns)


def typed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every content type with that type."""
    kinds = {
        "log": as_documents(log_lines(spark, sf_dir)),
        "test_output": as_documents(test_lines(spark, sf_dir)),
        "command_output": as_documents(command_lines(spark, sf_dir)),
        "code": as_documents(code_lines(spark, sf_dir)),
        "json": json_documents(spark, sf_dir),
        "markdown": markdown_documents(spark, sf_dir),
        "rag_chunk": rag_documents(spark, sf_dir),
        "conversation_history": conversation_documents(spark, sf_dir),
        "plain_text": corpus(spark, sf_dir),
    }
    every = None
    for kind, docs in kinds.items():
        part = docs.select(
            "scope_id",
            F.concat(F.lit(kind + "_"), F.col("doc_id")).alias("doc_id"),
            F.lit(kind).alias("content_type"),
            "content",
        )
        every = part if every is None else every.unionByName(part)
    return every
