"""Batch maintenance of the memory, fact and original tables.

A batch of change requests and a table snapshot give a new snapshot plus
outcome rows. Nothing is changed in place: the caller writes the new snapshot
and swaps it in. Joins are on (scope, id) or (scope, fingerprint); a
fingerprint that many requests share is reduced to its first request by an
aggregate that combines before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions.text import fingerprint, source_ref, trim
from corpusmill.operators import inorder
from corpusmill.operators.lookup import valid_transition
from corpusmill.session import as_time
from corpusmill.sources.store import conform, new_failures, new_profile_facts, new_receipts

# The status a forget mode leads to.
MODE_STATUS = {"soft_forget": "forgotten", "supersede": "superseded", "expire": "expired"}


@dataclass(frozen=True)
class Change:
    """Result of a batch: the new snapshot, one outcome row per request, and new facts and receipts."""

    table: DataFrame
    outcomes: DataFrame
    rejects: DataFrame
    facts: DataFrame | None = None
    receipts: DataFrame | None = None


def remember(memories: DataFrame, requests: DataFrame, now: Column | str) -> Change:
    """M1 and M2: create, deduplicate or replace.

    Requests carry request_id, scope_id, type, content and optionally summary,
    source_ref, confidence, expires_at, tags, profile_target and
    supersedes_memory_id. They are done one after the other in request_id order
    within their scope, each on what the ones before left behind
    (:mod:`inorder`); a batch gives what its requests would give if they came
    alone. Outcome actions are created, deduplicated and replaced; a request
    whose target is missing or not active is rejected. Made memories that name a
    profile layer give a fact, and every request that is not rejected a receipt.
    """
    at = as_time(now)
    optional = {
        "summary": "string", "source_ref": "string", "confidence": "double",
        "expires_at": "timestamp_ntz", "tags": "array<string>", "profile_target": "string",
        "supersedes_memory_id": "string",
    }
    for name, kind in optional.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    fp = fingerprint(F.col("scope_id"), F.col("type"), F.col("content"))
    keyed = requests.withColumn("fingerprint", fp)
    new_id = F.concat(
        F.lit("mem_"), F.sha2(F.concat_ws("|", "fingerprint", F.col("request_id").cast("string")), 256)
    )

    judged = inorder.play(memories, keyed.select("request_id", "scope_id", "fingerprint", F.col("supersedes_memory_id").alias("target"), new_id.alias("new_id")))
    replaced = judged.filter(F.col("action") == "replaced")
    outcomes = judged.filter(F.col("action") != "rejected").select(
        "request_id", "scope_id", "action", "memory_id", F.when(F.col("action") == "replaced", F.col("target")).alias("superseded_memory_id")
    )
    rejects = judged.filter(F.col("action") == "rejected").select("request_id", "scope_id", F.col("target").alias("supersedes_memory_id"), "reason")

    made = judged.filter(F.col("action").isin("created", "replaced")).select("scope_id", "request_id")
    created = keyed.withColumn("memory_id", new_id).join(made, ["scope_id", "request_id"], "left_semi")
    facts = new_profile_facts(created, now)
    created = conform(
        created.withColumn("status", F.lit("active")), schemas.MEMORIES, confidence=F.lit(0.8), created_at=at, updated_at=at
    )
    # a memory that one request of the batch makes and a later one replaces ends superseded
    ends = replaced.select("scope_id", F.col("target").alias("memory_id"), F.col("new_id").alias("_successor"))
    gone = F.col("_successor").isNotNull()
    table = conform(memories, schemas.MEMORIES).unionByName(created).join(ends, ["scope_id", "memory_id"], "left").withColumns(
        {
            "status": F.when(gone, "superseded").otherwise(F.col("status")),
            "superseded_by": F.coalesce("_successor", "superseded_by"),
            "updated_at": F.when(gone, at).otherwise(F.col("updated_at")),
        }
    )
    ids = F.when(F.col("action") == "replaced", F.array("memory_id", "target")).otherwise(F.array("memory_id"))
    audited = judged.filter(F.col("action") != "rejected").withColumns({"memory_ids": ids, "compressed": F.lit(True)})
    receipts = new_receipts(audited, "remember", now, ["scope_id", "request_id"])
    return Change(conform(table, schemas.MEMORIES), outcomes, rejects, facts, receipts)


def forget(
    memories: DataFrame, facts: DataFrame, requests: DataFrame, now: Column | str
) -> tuple[Change, DataFrame]:
    """M3: soft_forget, supersede, expire or hard_delete, with the remaining facts.

    Requests carry request_id, scope_id, memory_id, mode, reason and
    superseded_by; of several for one memory the first is done.
    """
    at = as_time(now)
    status = memories.select("scope_id", "memory_id", F.col("status").alias("previous_status"))
    new_status = F.lit(None).cast("string")
    for mode, to in MODE_STATUS.items():
        new_status = F.when(F.col("mode") == mode, to).otherwise(new_status)
    judged = (
        requests.join(status, ["scope_id", "memory_id"], "left")
        .withColumn("new_status", new_status)
        .withColumn(
            "reject",
            F.when(F.col("previous_status").isNull(), "memory_not_found")
            .when(F.col("mode") == "hard_delete", F.lit(None))
            .when(F.col("new_status").isNull(), "unknown_mode")
            .when(
                ~valid_transition(F.col("previous_status"), F.col("new_status")),
                "invalid_transition",
            ),
        )
    )
    good = judged.filter(F.col("reject").isNull())
    first = good.groupBy("scope_id", "memory_id").agg(F.min("request_id").alias("_first"))
    marked = judged.join(first, ["scope_id", "memory_id"], "left")
    late = F.col("reject").isNull() & (F.col("request_id") != F.col("_first"))
    marked = marked.withColumn("reject", F.when(late, "already_handled").otherwise(F.col("reject")))
    done = marked.filter(F.col("reject").isNull())

    fact_count = facts.groupBy("scope_id", F.col("source_memory_id").alias("memory_id")).agg(
        F.count(F.lit(1)).alias("_facts")
    )
    hard = F.col("mode") == "hard_delete"
    outcomes = done.join(fact_count, ["scope_id", "memory_id"], "left").select(
        "request_id", "scope_id", "memory_id", "mode", "reason", "previous_status", "new_status",
        F.when(hard, F.coalesce("_facts", F.lit(0))).alias("facts_deleted"),
    )
    rejects = marked.filter(F.col("reject").isNotNull()).select(
        "request_id", "scope_id", "memory_id", "mode", F.col("reject").alias("reason")
    )
    deleted = done.filter(hard).select("scope_id", "memory_id")
    changed = done.filter(~hard).select(
        "scope_id", "memory_id", F.col("new_status").alias("_to"),
        F.col("superseded_by").alias("_successor"),
    )
    kept = (
        memories.join(deleted, ["scope_id", "memory_id"], "left_anti")
        .join(changed, ["scope_id", "memory_id"], "left")
        .withColumns(
            {
                "status": F.coalesce("_to", "status"),
                "superseded_by": F.coalesce("_successor", "superseded_by"),
                "updated_at": F.when(F.col("_to").isNotNull(), at).otherwise(F.col("updated_at")),
            }
        )
        .drop("_to", "_successor")
    )
    remaining = facts.join(
        deleted.withColumnRenamed("memory_id", "source_memory_id"),
        ["scope_id", "source_memory_id"], "left_anti",
    )
    return Change(kept, outcomes, rejects), remaining


def expire_memories(memories: DataFrame, now: Column | str) -> DataFrame:
    """M5: active memories whose expiry lies before now become expired."""
    at = as_time(now)
    due = (F.col("status") == "active") & F.coalesce(F.col("expires_at") < at, F.lit(False))
    return memories.withColumns(
        {
            "status": F.when(due, "expired").otherwise(F.col("status")),
            "updated_at": F.when(due, at).otherwise(F.col("updated_at")),
        }
    )


MEMORY_UPDATES = ("summary", "content", "confidence", "tags", "expires_at", "superseded_by")


def update_memories(memories: DataFrame, updates: DataFrame, now: Column | str) -> Change:
    """M6: (scope_id, memory_id, new_status) with optional fields; null keeps the old value."""
    given = [c for c in MEMORY_UPDATES if c in updates.columns]
    status = memories.select("scope_id", "memory_id", "status")
    judged = updates.join(status, ["scope_id", "memory_id"], "left").withColumn(
        "reason",
        F.when(F.col("status").isNull(), "memory_not_found").when(
            ~valid_transition(F.col("status"), F.col("new_status")), "invalid_transition"
        ),
    )
    good = judged.filter(F.col("reason").isNull())
    rename = {c: f"_new_{c}" for c in given}
    patch = good.select(
        "scope_id", "memory_id", "new_status", *[F.col(c).alias(n) for c, n in rename.items()]
    )
    hit = F.col("new_status").isNotNull()
    changed = memories.join(patch, ["scope_id", "memory_id"], "left").withColumns(
        {
            **{c: F.coalesce(n, c) for c, n in rename.items()},
            "status": F.coalesce("new_status", "status"),
            "updated_at": F.when(hit, as_time(now)).otherwise(F.col("updated_at")),
        }
    )
    outcomes = good.select("scope_id", "memory_id", F.col("status").alias("previous_status"), "new_status")
    rejects = judged.filter(F.col("reason").isNotNull()).select("scope_id", "memory_id", "reason")
    return Change(changed.drop("new_status", *rename.values()), outcomes, rejects)


FACT_UPDATES = ("content", "source_memory_id", "source_ref", "confidence", "expires_at")


def update_facts(facts: DataFrame, changes: DataFrame, now: Column | str) -> Change:
    """M7: action update, expire or delete, guarded by the expected layer."""
    at = as_time(now)
    given = [c for c in FACT_UPDATES if c in changes.columns]
    layer = facts.select("scope_id", "fact_id", "layer")
    judged = changes.join(layer, ["scope_id", "fact_id"], "left").withColumn(
        "reason",
        F.when(F.col("layer").isNull(), "fact_not_found").when(
            (F.col("action") != "delete") & (F.col("layer") != F.col("expected_layer")),
            "layer_mismatch",
        ),
    )
    good = judged.filter(F.col("reason").isNull())
    rename = {c: f"_new_{c}" for c in given}
    patch = good.select(
        "scope_id", "fact_id", "action", *[F.col(c).alias(n) for c, n in rename.items()]
    )
    patched = facts.join(patch, ["scope_id", "fact_id"], "left")
    updating = F.col("action") == "update"
    values = {c: F.when(updating, F.coalesce(n, c)).otherwise(F.col(c)) for c, n in rename.items()}
    expires = values.get("expires_at", F.col("expires_at"))
    values["expires_at"] = F.when(F.col("action") == "expire", at).otherwise(expires)
    values["updated_at"] = F.when(F.col("action").isNotNull(), at).otherwise(F.col("updated_at"))
    table = (
        patched.filter(F.col("action").isNull() | (F.col("action") != "delete"))
        .withColumns(values)
        .drop("action", *rename.values())
    )
    outcomes = good.select("scope_id", "fact_id", "action")
    rejects = judged.filter(F.col("reason").isNotNull()).select(
        "scope_id", "fact_id", "action", "reason"
    )
    return Change(table, outcomes, rejects)


def backfill_fingerprints(memories: DataFrame) -> DataFrame:
    """M8: compute the fingerprint where it is missing or empty."""
    missing = F.coalesce(F.col("fingerprint"), F.lit("")) == ""
    fp = fingerprint(F.col("scope_id"), F.col("type"), F.col("content"))
    return memories.withColumn("fingerprint", F.when(missing, fp).otherwise(F.col("fingerprint")))


def backfill_counts(memories: DataFrame) -> DataFrame:
    """M8: one row, eligible (all of which are backfilled) and preserved rows."""
    missing = F.coalesce(F.col("fingerprint"), F.lit("")) == ""
    return memories.agg(
        F.count_if(missing).alias("eligible_rows"),
        F.count_if(missing).alias("backfilled_rows"),
        F.count_if(~missing).alias("preserved_rows"),
    )


def derive_references(requests: DataFrame, compressed: DataFrame, originals: DataFrame) -> DataFrame:
    """M9: source_ref and summary from ccr_id or original_ref, with errors and warnings."""
    ccr = compressed.select(
        "scope_id", "ccr_id", F.col("summary").alias("_ccr_summary"),
        F.col("content_type").alias("_ccr_type"),
    )
    stored = originals.select(
        F.col("original_id").alias("original_ref"), F.col("scope_id").alias("_original_scope")
    )
    joined = requests.join(ccr, ["scope_id", "ccr_id"], "left").join(stored, "original_ref", "left")
    has_ccr, has_original = F.col("ccr_id").isNotNull(), F.col("original_ref").isNotNull()
    error = (
        F.when(has_ccr & F.col("_ccr_type").isNull(), "ccr_not_found")
        .when(has_original & F.col("_original_scope").isNull(), "original_not_found")
        .when(has_original & (F.col("_original_scope") != F.col("scope_id")), "original_in_other_scope")
    )
    ref = F.coalesce(
        F.when(F.length(trim(F.col("source_ref"))) > 0, trim(F.col("source_ref"))),
        F.when(has_ccr, source_ref("ccr", F.col("ccr_id"))),
        F.when(has_original, source_ref("orig", F.col("original_ref"))),
    )
    warning = F.when(
        (F.col("_ccr_type") == "test_output") & (F.col("type") != "test_failure"),
        "type_should_be_test_failure",
    ).when(
        (F.col("_ccr_type") == "file_summary") & (F.col("type") != "file_summary"),
        "type_should_be_file_summary",
    )
    given = F.when(F.length(trim(F.col("summary"))) > 0, trim(F.col("summary")))
    return joined.withColumns(
        {
            "source_ref": ref,
            "summary": F.coalesce(given, "_ccr_summary"),
            "error": error,
            "warning": warning,
        }
    ).drop("_ccr_summary", "_ccr_type", "_original_scope")


@dataclass(frozen=True)
class Deletion:
    """Result of deleting originals."""

    originals: DataFrame
    compressed: DataFrame
    deleted: DataFrame
    affected: DataFrame


def delete_originals(
    originals: DataFrame, compressed: DataFrame, doomed: Column, now: Column | str
) -> Deletion:
    """Delete originals by predicate; rows left without one lose the flag."""
    bad = F.coalesce(doomed, F.lit(False))
    survivors = originals.filter(~bad)
    deleted = originals.filter(bad).select("original_id", "scope_id", "ccr_id")
    affected = (
        deleted.select("ccr_id").distinct().join(
            survivors.select("ccr_id").distinct(), "ccr_id", "left_anti"
        )
    )
    lost = affected.withColumn("_lost", F.lit(True))
    updated = (
        compressed.join(lost, "ccr_id", "left")
        .withColumns(
            {
                "can_retrieve_original": F.when(F.col("_lost"), F.lit(False)).otherwise(
                    F.col("can_retrieve_original")
                ),
                "updated_at": F.when(F.col("_lost"), as_time(now)).otherwise(F.col("updated_at")),
            }
        )
        .drop("_lost")
    )
    return Deletion(survivors, updated, deleted, affected)


def expire_originals(originals: DataFrame, compressed: DataFrame, now: Column | str) -> Deletion:
    """Originals expire at or before now."""
    return delete_originals(originals, compressed, F.col("expires_at") <= as_time(now), now)


def clear_cache(
    compressed: DataFrame, originals: DataFrame, scopes: list[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(compressed, originals, deleted ccr ids) without the cache entries."""
    entry = F.col("cache_key").isNotNull()
    if scopes:
        entry = entry & F.col("scope_id").isin(*scopes)
    deleted = compressed.filter(entry).select("ccr_id")
    return (
        compressed.filter(~entry),
        originals.join(deleted, "ccr_id", "left_anti"),
        deleted,
    )


def count_retrievals(compressed: DataFrame, retrievals: DataFrame) -> DataFrame:
    """Add the number of retrievals (ccr_id rows) to retrieve_count."""
    counts = retrievals.groupBy("ccr_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        compressed.join(counts, "ccr_id", "left")
        .withColumn("retrieve_count", F.col("retrieve_count") + F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )


def wrong_memory_events(forgotten: DataFrame, now: Column | str) -> DataFrame:
    """A failure event for every carried out forget."""
    metadata = F.to_json(
        F.struct(F.col("mode").alias("forgetMode"), F.col("previous_status").alias("previousStatus"),
                 "reason")
    )
    rows = forgotten.withColumns(
        {
            "error_reason": F.concat(F.lit("forgotten_via_"), F.col("mode")),
            "metadata": metadata,
        }
    )
    return new_failures(rows, "recall", "recall_wrong_memory", now, ["scope_id", "memory_id"])


# Words that make content verification-sensitive.
SENSITIVE = (
    r"(?i)(?<![A-Za-z0-9_])(?:build|security[ -]?scan|vulnerability|sast|dast|dependency[ -]?audit)"
    r"(?![A-Za-z0-9_])"
)


def verification_sensitive(content_type: Column, content: Column, goal: Column) -> Column:
    text = F.concat(F.coalesce(goal, F.lit("")), F.lit("\n"), content)
    return content_type.isin("test_output", "command_output") | text.rlike(SENSITIVE)


def verification_status(status: Column, contradictory: Column) -> Column:
    s = F.upper(trim(status))
    return (
        F.when(F.coalesce(contradictory, F.lit(False)) | s.isin("CONTRADICTORY", "CONFLICTING"),
               "CONTRADICTORY")
        .when(s.isin("VERIFIED", "UNVERIFIED"), s)
        .otherwise("UNKNOWN")
    )


def admit_summaries(rows: DataFrame, require_verified: bool = False) -> DataFrame:
    """May a summary be saved as a memory? Adds admitted and reason.

    Rows carry content_type, content, goal, facts, inferences (arrays),
    verification, contradictory, compression_ok, ccr_saved and original_saved.
    """
    status = verification_status(F.col("verification"), F.col("contradictory"))
    staged = rows.withColumns(
        {
            "_status": status,
            "_sensitive": verification_sensitive(
                F.col("content_type"), F.col("content"), F.col("goal")
            ),
        }
    )
    sensitive, st = F.col("_sensitive"), F.col("_status")

    def usable(column: str) -> Column:
        items = F.filter(F.col(column), lambda x: F.length(trim(x)) > 0)
        return F.coalesce(F.size(items), F.lit(0)) > 0

    something = usable("facts") | (~sensitive & usable("inferences"))
    reason = (
        F.when(~F.col("ccr_saved"), "compressed row was not saved")
        .when(~F.col("compression_ok"), "compression failed")
        .when(F.col("content_type") == "unknown", "content type is unknown")
        .when(st == "CONTRADICTORY", "summary is contradictory")
        .when(st == "UNKNOWN", "verification status is unknown")
        .when(F.lit(require_verified) & (st != "VERIFIED"), "verified summary is required")
        .when(sensitive & (st != "VERIFIED"), "verifiable output requires a verified summary")
        .when(sensitive & ~F.col("original_saved"), "verifiable output requires a saved original")
        .when(~something & sensitive, "verifiable output has no verified facts")
        .when(~something, "summary has no admissible facts or inferences")
    )
    return staged.withColumns({"reason": reason}).withColumn(
        "admitted", F.col("reason").isNull()
    ).drop("_status", "_sensitive")
