"""Compression with size limits, cache reuse and failure events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.chunk import DEFAULT_MAX_TOKENS as CHUNK_TOKENS
from corpusmill.operators.chunk import chunk_texts
from corpusmill.operators.compress.engine import (
    RESULT, apply_strategy, finish, goal_of, resolved_type, strategy_version,
)
from corpusmill.session import as_time
from corpusmill.sources.store import new_failures


def safe_compress(
    docs: DataFrame,
    max_tokens: int = 2000,
    max_input_bytes: int = T.MAX_INPUT_BYTES,
    chunk_tokens: int = CHUNK_TOKENS,
    enable_chunking: bool = True,
    fail_open: bool = True,
    types: Sequence[str] | None = None,
) -> DataFrame:
    """Compress; oversized documents in chunks that are merged again.

    Adds safety_action: size_ok, size_truncated, size_rejected or chunked. All
    chunks of a document are kept. Chunks are compressed inside the document's
    own row, so there is no shuffle and the strategies are planned once.
    """
    content, kind = F.col("content"), F.col("content_type")
    size = F.octet_length("content")
    if enable_chunking:
        action = F.when(size > max_input_bytes, "chunked").otherwise("size_ok")
        pieces = F.when(size > max_input_bytes, chunk_texts(content, kind, chunk_tokens)).otherwise(
            F.array(content)
        )
    else:
        guard = T.size_guard(content, max_input_bytes, fail_open)
        action = guard["code"]
        pieces = F.when(action == "size_rejected", F.array().cast("array<string>")).otherwise(
            F.array(guard["content"])
        )
    staged = docs.withColumns({"safety_action": action, "_pieces": pieces})
    results = F.transform(
        "_pieces", lambda p: apply_strategy(p, kind, max_tokens, goal_of(docs), types)
    )
    staged = staged.withColumn("_results", results)
    n = F.size("_pieces")

    def one(r: Column, i: Column) -> Column:
        text = F.coalesce(F.nullif(r["compressed_content"], F.lit("")), F.get("_pieces", i))
        return F.concat(F.lit("[Chunk "), (i + 1).cast("string"), F.lit("/"), n.cast("string"), F.lit("]\n"), text)

    merged = F.struct(
        F.array_join(F.transform("_results", one), "\n\n---\n\n").alias("compressed_content"),
        F.concat(F.lit("[Chunked] "), n, F.lit(" chunks compressed and merged.")).alias("summary"),
        F.array(F.concat(F.lit("Merged "), n, F.lit(" chunks"))).alias("warnings"),
    ).cast(RESULT)
    chunked = F.col("safety_action") == "chunked"
    whole = F.when(chunked, merged).otherwise(F.get("_results", F.lit(0)))
    done = finish(staged.withColumn("_r", whole))
    rejected = F.col("safety_action") == "size_rejected"
    return done.withColumns(
        {
            "strategy": F.when(chunked, F.concat(F.lit("chunked("), n, F.lit(")_"), "strategy")).otherwise(
                F.col("strategy")
            ),
            "error_reason": F.when(rejected, "safety_fail_open").otherwise(F.col("error_reason")),
        }
    ).drop("_pieces", "_results")


POOR_RATIO = 0.05


def compression_failures(
    results: DataFrame, now: Column | str, id_from: Sequence[str] = ("scope_id", "doc_id")
) -> DataFrame:
    """Failure events of compression results, up to two a row."""
    failed, ratio = F.col("failed"), F.col("compression_ratio")
    oversized = F.col("safety_action").isin("size_truncated", "size_rejected")
    percent = F.floor(ratio * 100 + 0.5).cast("string")

    def event(condition: Column, kind: str, reason: Column) -> Column:
        return F.when(
            condition, F.struct(F.lit(kind).alias("event_type"), reason.alias("error_reason"))
        )

    timeout = F.coalesce(F.col("error_reason").contains("timeout"), F.lit(False))
    events = F.array_compact(
        F.array(
            event(failed & timeout, "compression_timeout", F.col("error_reason")),
            event(failed & ~timeout, "compression_error", F.col("error_reason")),
            event(oversized, "oversized_input", F.lit("input_exceeded_size_limit")),
            event(
                ~failed & (ratio < POOR_RATIO), "poor_compression_ratio",
                F.concat(F.lit("compression_ratio_"), percent, F.lit("pct")),
            ),
        )
    )
    rows = results.withColumn("_e", F.explode(events)).drop("error_reason")
    rows = rows.withColumn("error_reason", F.col("_e.error_reason"))
    return new_failures(rows, "compress", F.col("_e.event_type"), now, id_from)


@dataclass(frozen=True)
class CacheLookup:
    """Requests served from the cache, requests to compute, and new hit counts."""

    hits: DataFrame
    misses: DataFrame
    compressed: DataFrame
    repaired: DataFrame


def with_cache_key(requests: DataFrame, max_tokens: int, keep_original: bool = True) -> DataFrame:
    """H5 for a request table (scope_id, content, content_type[, goal])."""
    kind = F.coalesce(resolved_type(F.col("content_type")), F.lit("plain_text"))
    version = strategy_version(F.col("content_type"))
    key = T.cache_key(
        F.col("scope_id"), F.col("content"), kind, version, F.lit(max_tokens), F.lit(keep_original),
        F.col("goal") if "goal" in requests.columns else None,
    )
    return requests.withColumn("cache_key", F.when(F.length(version) > 0, key))


def reuse_cache(
    requests: DataFrame, compressed: DataFrame, originals: DataFrame, now: Column | str
) -> CacheLookup:
    """Serve requests whose key is known; the rest are computed once per key.

    A known row whose original is gone is repaired from the request's text.
    Requests carry request_id, scope_id, cache_key and content.
    """
    cached = compressed.filter(
        F.col("cache_key").isNotNull() & (F.coalesce(F.length("compressed_content"), F.lit(0)) > 0)
    ).select(
        "scope_id", "cache_key", "ccr_id", "compressed_content", "summary", "original_ref",
        "can_retrieve_original", "tokens_before", "tokens_after", "tokens_saved", "compression_ratio",
    )
    stored = originals.select(
        "scope_id", F.col("original_id").alias("original_ref"), F.lit(True).alias("_stored")
    ).distinct()
    known = cached.join(stored, ["scope_id", "original_ref"], "left").withColumn(
        "needs_repair", F.col("_stored").isNull() | ~F.col("can_retrieve_original")
    ).drop("_stored")
    # a key may have been written twice: the row that needs no repair answers, then the one of least id
    rest = F.struct(*[F.col(c) for c in known.columns if c not in ("scope_id", "cache_key")])
    best = F.min_by(rest, F.struct("needs_repair", "ccr_id")).alias("_best")
    known = known.groupBy("scope_id", "cache_key").agg(best).select("scope_id", "cache_key", "_best.*")
    # what the cached row brings takes the place of columns of the same name
    requests = requests.drop(*[c for c in known.columns if c not in ("scope_id", "cache_key")])
    hits = requests.join(known, ["scope_id", "cache_key"])
    served = known.select("scope_id", "cache_key")
    misses = requests.join(served, ["scope_id", "cache_key"], "left_anti")
    once = misses.groupBy("scope_id", "cache_key").agg(F.min("request_id").alias("request_id"))
    keyless = misses.filter(F.col("cache_key").isNull())
    computed = misses.join(once.select("request_id"), "request_id", "left_semi").unionByName(
        keyless.join(once.select("request_id"), "request_id", "left_anti")
    )
    counts = hits.groupBy("ccr_id").agg(F.count(F.lit(1)).alias("_n"))
    updated = _count_hits(compressed, counts, now)
    repaired = (
        hits.filter("needs_repair")
        .groupBy("scope_id", "ccr_id")
        .agg(F.min_by("content", "request_id").alias("content"))
        .withColumn("original_id", F.concat(F.lit("orig_"), T.content_hash(F.col("content"))))
    )
    return CacheLookup(hits, computed, updated, repaired)


def _count_hits(compressed: DataFrame, counts: DataFrame, now: Column | str) -> DataFrame:
    at = F.when(F.col("_n") > 0, as_time(now)).otherwise(F.col("last_accessed_at"))
    return (
        compressed.join(counts, "ccr_id", "left")
        .withColumns(
            {
                "last_accessed_at": at,
                "cache_hit_count": F.col("cache_hit_count") + F.coalesce("_n", F.lit(0)),
            }
        )
        .drop("_n")
    )
