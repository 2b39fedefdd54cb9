"""Queries that run the streaming jobs to the end of the given tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from checks.registry import query
from corpusmill.operators.route import route
from corpusmill.plans import safety
from corpusmill.sources import testdata as td
from corpusmill.streaming import jobs as J


def _folder(spark) -> str:
    """A new folder: in the cluster's shared checkpoint folder where one is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    name = tempfile.mkdtemp(prefix="run-", dir="/tmp").rsplit("/", 1)[1]
    return f"{shared.rstrip('/')}/{name}" if shared else f"/tmp/{name}"


def _stream(spark, sf, name):
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # a table is a file or a folder of files; a stream starts from a single file only through a pattern
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _run(spark, stream, mode="append"):
    folder = _folder(spark)
    J.run_to_end(stream, f"{folder}/out", f"{folder}/state", mode)
    return spark.read.parquet(f"{folder}/out")


@query("stream_token_stats", """
  SELECT scope_id, count_if(operation = 'compress') AS compressions, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved FROM t_rcp GROUP BY scope_id""")
def stream_token_stats(spark, sf):
    stats = J.running_token_stats(td.receipts_from(_stream(spark, sf, "events")))
    return _run(spark, stats, "update").select("scope_id", "compressions", "tokens_saved")


@query("stream_recent_failures", """
  WITH w AS (SELECT scope_id, unnest(generate_series(0, 23)) AS h, date_trunc('hour', created_at) AS t FROM t_fail)
  SELECT scope_id, CAST(t - to_hours(h) AS VARCHAR) AS from_time, count(*) AS failures FROM w GROUP BY ALL""")
def stream_recent_failures(spark, sf):
    recent = J.recent_failures(td.failures_from(_stream(spark, sf, "events")))
    out = _run(spark, recent, "complete")
    return out.select("scope_id", F.col("from_time").cast("string").alias("from_time"), "failures")


@query("stream_high_retrieve_alerts", """
  SELECT 'all' AS scope_id, ccr_id FROM t_rcp WHERE operation = 'retrieve_original' GROUP BY ccr_id HAVING count(*) >= 5""")
def stream_high_retrieve_alerts(spark, sf):
    seen = td.receipts_from(_stream(spark, sf, "events")).filter("operation = 'retrieve_original'")
    # one scope for all, so that rows of the smallest table reach the threshold
    alerts = J.high_retrieve_alerts(seen.select(F.lit("all").alias("scope_id"), F.get("ccr_ids", F.lit(0)).alias("ccr_id")))
    return _run(spark, alerts).select("scope_id", "ccr_id")


@query("stream_remember", """
  SELECT count(*) AS memories, count(DISTINCT sha256(scope_id || content)) AS texts FROM (
    SELECT DISTINCT source AS scope_id, trim(text, chr(10) || ' ') AS content FROM documents)""")
def stream_remember(spark, sf):
    docs = _stream(spark, sf, "documents").select(
        F.col("doc_id").alias("request_id"), F.col("source").alias("scope_id"), F.lit("decision").alias("type"),
        F.col("text").alias("content"))
    folder = _folder(spark)
    nothing = td.memories(spark, sf).filter("false")
    J.remember_stream(docs, nothing, f"{folder}/memories", f"{folder}/state", td.NOW).trigger(availableNow=True).start().awaitTermination()
    table = J.latest_snapshot(spark, f"{folder}/memories")
    return table.agg(F.count(F.lit(1)).alias("memories"), F.count_distinct("fingerprint").alias("texts"))


@query("stream_cache_hits", """
  SELECT doc_id AS request_id FROM documents d WHERE sha256(source || text) IN (SELECT sha256(source || text) FROM documents WHERE doc_id % 3 = 0)""")
def stream_cache_hits(spark, sf):
    from corpusmill import schemas
    from corpusmill.sources.store import conform, new_compressed

    def requests(df):
        docs = df.select(F.col("doc_id").alias("request_id"), F.col("source").alias("scope_id"),
                         F.lit("plain_text").alias("content_type"), F.col("text").alias("content"))
        return safety.with_cache_key(docs, 2000)

    def tables(session):
        known = requests(td.table(session, sf, "documents")).filter("request_id % 3 = 0").dropDuplicates(["cache_key"])
        rows = known.select(F.concat(F.lit("ccr_"), "request_id").alias("ccr_id"), "scope_id", "cache_key",
                            F.lit("x").alias("compressed_content"), F.lit("orig_1").alias("original_ref"))
        return new_compressed(rows, td.NOW), conform(rows.select("scope_id", "ccr_id").filter("false"), schemas.ORIGINALS)

    folder = _folder(spark)
    stream = J.resolve_cache_stream(requests(_stream(spark, sf, "documents")), tables, f"{folder}/out", f"{folder}/state", td.NOW)
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out/hits").select("request_id")


@query("stream_routed_pages", "SELECT page_id AS doc_id, 1 AS n FROM pages")
def stream_routed_pages(spark, sf):
    docs = _stream(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content"))
    routed = route(docs).select("doc_id", "content_type")
    return _run(spark, routed).select("doc_id", F.col("content_type").isNotNull().cast("int").alias("n"))
