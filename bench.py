"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from corpusmill.functions.text import token_count
from corpusmill.operators import analyze, memory, recall, route
from corpusmill.operators.chunk import chunk
from corpusmill.operators.compress import compress
from corpusmill.plans import reports
from corpusmill.session import build_session
from corpusmill.sources import testdata as td
from pyspark.sql import functions as F


def headline(spark, sf):
    """Name to DataFrame builder."""
    plain = lambda: td.corpus(spark, sf).withColumn("content_type", F.lit("plain_text"))
    logs = lambda: td.as_documents(td.log_lines(spark, sf)).withColumn("content_type", F.lit("log"))
    return {
        "route_corpus": lambda: route.route(td.corpus(spark, sf))
        .groupBy("scope_id", "content_type")
        .agg(F.count(F.lit(1)), F.sum(token_count(F.col("content")))),
        "compress_plain_text": lambda: compress(plain(), 300, types=["plain_text"]),
        "compress_logs": lambda: compress(logs(), 300, types=["log"]),
        "chunk_corpus": lambda: chunk(plain(), 500),
        "analyze_corpus": lambda: analyze.analyze(plain()),
        "recall_search": lambda: recall.search(td.memories(spark, sf), td.recall_queries(spark, sf), td.NOW),
        "remember_batch": lambda: memory.remember(
            td.memories(spark, sf),
            td.table(spark, sf, "documents").select(
                F.col("doc_id").alias("request_id"), F.col("source").alias("scope_id"),
                F.lit("decision").alias("type"), F.col("text").alias("content")),
            td.NOW,
        ).outcomes,
        **{
            f"compress_{kind}": lambda kind=kind: compress(td.typed_corpus(spark, sf).filter(F.col("content_type") == kind), 300, types=[kind])
            for kind in ("test_output", "command_output", "code", "json", "markdown", "rag_chunk", "conversation_history")
        },
        "token_stats": lambda: reports.token_stats(td.receipts(spark, sf)),
        "failure_stats": lambda: reports.failure_stats(td.failures(spark, sf), "2024-01-30 00:00:00"),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # the tables are dealt over the cores once, untimed: a small file is one row group, and so one task
    dealt = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name in ("documents", "events", "benchmark", "labels", "conversations", "pages", "part"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(int(cpus)).write.parquet(f"{dealt}/{name}.parquet")
    source, sf = sf, dealt
    next(iter(headline(spark, sf).values()))().write.format("noop").mode("overwrite").save()  # warm up
    times = {}
    for name, build in headline(spark, sf).items():
        started = time.time()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    size = td.corpus(spark, sf).agg(F.count(F.lit(1)), F.sum(F.octet_length("content"))).first()
    seconds = times["compress_plain_text"]
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(source.rstrip("/")).removeprefix("sf"),
                "documents": size[0],
                "bytes": size[1],
                "compress_documents_per_sec": round(size[0] / seconds, 1),
                "compress_bytes_per_sec": round(size[1] / seconds),
            }
        )
    )


if __name__ == "__main__":
    main()
