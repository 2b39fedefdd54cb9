"""The whole context flow as one job: reuse or compress, store, remember, recall (N8), and its commit as one run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions import text as T
from corpusmill.operators import memory as M
from corpusmill.operators import recall as K
from corpusmill.operators.route import route
from corpusmill.plans.safety import CacheLookup, compression_failures, reuse_cache, safe_compress, with_cache_key
from corpusmill.session import written
from corpusmill.sources import store

STEP = "struct<status:string,reason:string>"


def step(ok: Column, failed: Column, skipped: Column | None) -> Column:
    """struct(status, reason): skipped with a reason, failed, or ok."""
    reason = F.lit(None).cast("string") if skipped is None else skipped
    status = (
        F.when(reason.isNotNull(), "skipped").when(failed, "failed").when(ok, "ok").otherwise("failed")
    )
    return F.struct(status.alias("status"), reason.alias("reason")).cast(STEP)


def overall(*steps: Column) -> Column:
    """ok without a failed step, else partial with an ok one, else failed."""
    requested = F.filter(
        F.array(*steps), lambda s: F.coalesce(s["reason"], F.lit("")) != "not requested"
    )
    failed = F.exists(requested, lambda s: s["status"] == "failed")
    some = F.exists(requested, lambda s: s["status"] == "ok")
    return F.when(~failed, "ok").when(some, "partial").otherwise("failed")


@dataclass(frozen=True)
class Flow:
    """The rows a flow adds, and the state of every request."""

    steps: DataFrame
    compressed: DataFrame
    originals: DataFrame
    memories: M.Change
    receipts: DataFrame
    failures: DataFrame
    cache: CacheLookup
    recall: K.Recall


#: What a request is answered with, whether computed or known.
ANSWER = ["ccr_id", "compressed_content", "summary", "original_ref", "tokens_before", "tokens_after", "tokens_saved", "compression_ratio"]


def _answered(keyed: DataFrame, computed: DataFrame, found: CacheLookup, ids: dict[str, Column]) -> DataFrame:
    """A row for each request: computed here, known from before, or the same as one computed here."""
    request = [c for c in keyed.columns if c not in ANSWER]
    own = computed.select(*request, *ANSWER, "failed", "error_reason", F.lit(False).alias("cache_hit"))
    stored = F.concat(F.lit("orig_"), F.sha2(F.concat_ws("|", "scope_id", "content"), 256))
    hits = found.hits.withColumn("original_ref", F.when(F.col("needs_repair"), stored).otherwise(F.col("original_ref")))
    known = hits.select(*request, *ANSWER, F.lit(False).alias("failed"), F.lit(None).cast("string").alias("error_reason"), F.lit(True).alias("cache_hit"))
    first = computed.filter(F.col("cache_key").isNotNull()).select("scope_id", "cache_key", *ANSWER, "failed", "error_reason")
    others = (
        keyed.join(own.select("request_id"), "request_id", "left_anti")
        .join(known.select("request_id"), "request_id", "left_anti")
        .join(first, ["scope_id", "cache_key"])
        .select(*request, *ANSWER, "failed", "error_reason", F.lit(True).alias("cache_hit"))
    )
    return own.unionByName(known).unionByName(others).withColumn("content_hash", ids["content_hash"])


def context_flow(
    requests: DataFrame,
    memories: DataFrame,
    originals: DataFrame,
    now: Column | str,
    max_tokens: int = 2000,
    require_verified: bool = False,
    compressed: DataFrame | None = None,
    profile: DataFrame | None = None,
) -> Flow:
    """Run the flow for a table of requests.

    Requests carry request_id, scope_id, content, goal, facts, inferences,
    verification, contradictory and, to recall as well, query (null or blank:
    not requested). A text that ``compressed`` knows under the same cache key is
    not compressed again, and its original is stored anew if it is gone; of
    equal requests in the batch one is computed. What the batch remembers is
    there to be recalled by it. Persistence is what was read back after writing.
    Ids derive from request ids, so a rerun makes the same rows.
    """
    spark = requests.sparkSession
    if "query" not in requests.columns:
        requests = requests.withColumn("query", F.lit(None).cast("string"))
    if compressed is None:
        compressed = store.new_compressed(spark.createDataFrame([], "ccr_id string"), now)
    if profile is None:
        profile = store.conform(spark.createDataFrame([], "fact_id string"), schemas.PROFILE_FACTS)
    typed = route(requests.withColumn("doc_id", F.col("request_id")))
    keyed = written(with_cache_key(typed, max_tokens), "requests")
    found = reuse_cache(keyed, compressed, originals, now)
    ids = {
        "ccr_id": F.concat(F.lit("ccr_"), F.sha2(F.concat_ws("|", "scope_id", F.col("request_id").cast("string")), 256)),
        "original_ref": F.concat(F.lit("orig_"), F.sha2(F.concat_ws("|", "scope_id", "content"), 256)),
        "content_hash": T.content_hash(F.col("content")),
    }
    done = written(safe_compress(found.misses, max_tokens).withColumns(ids), "compressed")
    answers = written(_answered(keyed, done, found, ids), "answers")

    rows = written(store.new_compressed(done, now), "compressed-rows")
    texts = answers.select(F.col("original_ref").alias("original_id"), "scope_id", "ccr_id", "content_type", "content")
    new_originals = written(store.new_originals(texts.filter(F.col("content").isNotNull()), originals, now), "originals")
    # what is there after writing, not what was meant to be
    kept_rows = rows.select("ccr_id").unionByName(compressed.select("ccr_id")).distinct().withColumn("ccr_saved", F.lit(True))
    kept_texts = new_originals.select("original_id").unionByName(originals.select("original_id")).distinct()
    kept_texts = kept_texts.select(F.col("original_id").alias("original_ref"), F.lit(True).alias("original_saved"))
    there = lambda c: F.coalesce(c, F.lit(False))
    judged = M.admit_summaries(
        answers.join(kept_rows, "ccr_id", "left").join(kept_texts, "original_ref", "left").withColumns(
            {"compression_ok": ~F.col("failed"), "ccr_saved": there("ccr_saved"), "original_saved": there("original_saved")}
        ),
        require_verified,
    )
    judged = written(judged, "judged")
    body = F.to_json(
        F.struct("facts", "inferences", F.col("verification").alias("verificationStatus"),
                 F.col("original_ref").alias("originalRef"))
    )
    to_remember = judged.filter("admitted").select(
        "request_id", "scope_id", F.lit("file_summary").alias("type"), body.alias("content"),
        "summary", F.concat(F.lit("ccr:"), F.col("ccr_id")).alias("source_ref"),
    )
    change = M.remember(memories, to_remember, now)
    asked = keyed.select("scope_id", F.col("request_id").alias("query_id"), "query").filter(F.length(F.trim("query")) > 0)
    recalled = K.recall(written(change.table, "memories"), asked, profile, compressed.unionByName(rows), now)
    n_hits = written(recalled.hits, "hits").groupBy(F.col("query_id").alias("request_id")).agg(F.count(F.lit(1)).alias("recalled"))
    outcome = change.outcomes.select("request_id", "action", "memory_id")
    wanted = F.coalesce(F.length(F.trim("query")) > 0, F.lit(False))
    saved_ = lambda c: step(F.col(c), ~F.col(c), None)
    states = judged.join(outcome, "request_id", "left").join(n_hits, "request_id", "left").select(
        "request_id",
        "scope_id",
        "ccr_id",
        "memory_id",
        "cache_hit",
        F.coalesce("recalled", F.lit(0)).alias("recalled"),
        step(~F.col("failed"), F.col("failed"), None).alias("compression"),
        saved_("ccr_saved").alias("persistence"),
        saved_("original_saved").alias("original"),
        step(F.col("action").isNotNull(), F.col("action").isNull(), F.col("reason")).alias("memory"),
        step(wanted, F.lit(False), F.when(~wanted, "not requested")).alias("recall"),
    )
    steps = states.withColumn(
        "status", overall(*[F.col(c) for c in ("compression", "persistence", "original", "memory", "recall")])
    )
    receipts = store.new_receipts(
        answers.withColumns(
            {
                "input_hash": F.col("content_hash"),
                "ccr_ids": F.array("ccr_id"),
                "original_refs": F.array("original_ref"),
            }
        ),
        "compress", now, ["request_id"],
    )
    failures = compression_failures(done, now, ["scope_id", "request_id"]).unionByName(recalled.failures)
    return Flow(steps, rows, new_originals, change, receipts, failures, found, recalled)


def _tables(flow: Flow) -> dict[str, DataFrame]:
    return {
        "compressed": flow.compressed, "originals": flow.originals, "memories": flow.memories.table, "facts": flow.memories.facts,
        "receipts": flow.receipts.unionByName(flow.memories.receipts).unionByName(flow.recall.receipts), "failures": flow.failures, "steps": flow.steps,
    }


def committed(spark: SparkSession, folder: str, run_id: str) -> dict[str, DataFrame] | None:
    """The tables of a run by name, or None unless its manifest, which is written last, is there."""
    try:
        manifest = spark.read.parquet(f"{folder}/run={run_id}/manifest").collect()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return {row["name"]: spark.read.schema(row["schema"]).parquet(f"{folder}/run={run_id}/{row['name']}") for row in manifest}


def commit(flow: Flow, folder: str, run_id: str) -> dict[str, DataFrame]:
    """Write the tables of a run and then its manifest (name, schema, rows).

    A run that was broken off has no manifest and is not seen; written again it
    overwrites what it left with the same rows. A run that has its manifest is
    returned as it is.
    """
    spark = flow.steps.sparkSession
    there = committed(spark, folder, run_id)
    if there is not None:
        return there
    manifest = []
    for name, table in _tables(flow).items():
        counted = Observation(name)
        table.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{folder}/run={run_id}/{name}")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
        manifest.append((name, ddl, counted.get["rows"]))
    spark.createDataFrame(manifest, "name string, schema string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/run={run_id}/manifest")
    return committed(spark, folder, run_id)
