"""Table schemas and enumerations of the data model."""

from __future__ import annotations

# Enumerations of the data model, in their natural order.
CONTENT_TYPES = (
    "test_output", "log", "command_output", "code", "json", "markdown",
    "plain_text", "rag_chunk", "file_summary", "conversation_history", "unknown",
)
MEMORY_TYPES = (
    "decision", "bug", "command", "file_summary", "project_rule",
    "user_preference", "current_task", "test_failure", "api_contract", "dependency",
)
MEMORY_STATUSES = ("active", "superseded", "forgotten", "expired")
FORGET_MODES = ("soft_forget", "supersede", "expire", "hard_delete")
OPERATIONS = (
    "compress", "retrieve_original", "delete_original", "cleanup_originals",
    "remember", "recall", "forget", "list", "harness_run", "harness_phase",
    "harness_checkpoint", "harness_check", "harness_artifact",
)
FAILURE_TYPES = (
    "compression_timeout", "compression_error", "oversized_input",
    "poor_compression_ratio", "recall_no_hit", "recall_low_confidence",
    "recall_wrong_memory", "high_retrieve_count",
)
FAILURE_OPERATIONS = ("compress", "recall", "retrieve_original")
PROFILE_LAYERS = ("static", "dynamic")

SCOPES = (
    "scope_id string, git_root string, remote string, branch string, cwd string, "
    "scope_strategy string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
COMPRESSED = (
    "ccr_id string, scope_id string, content_type string, strategy string, "
    "compressed_content string, summary string, original_ref string, source_ref string, "
    "metadata map<string,string>, tokens_before bigint, tokens_after bigint, "
    "tokens_saved bigint, compression_ratio double, can_retrieve_original boolean, "
    "retrieve_count bigint, failed boolean, error_reason string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, expires_at timestamp_ntz, "
    "content_hash string, cache_key string, strategy_version string, "
    "cache_hit_count bigint, last_accessed_at timestamp_ntz"
)
ORIGINALS = (
    "original_id string, scope_id string, ccr_id string, content_type string, "
    "content string, content_hash string, tokens bigint, metadata map<string,string>, "
    "created_at timestamp_ntz, expires_at timestamp_ntz"
)
MEMORIES = (
    "memory_id string, scope_id string, type string, content string, summary string, "
    "source_ref string, confidence double, status string, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, expires_at timestamp_ntz, superseded_by string, "
    "tags array<string>, fingerprint string"
)
PROFILE_FACTS = (
    "fact_id string, scope_id string, layer string, content string, "
    "source_memory_id string, source_ref string, confidence double, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, expires_at timestamp_ntz"
)
RECEIPTS = (
    "receipt_id string, operation string, scope_id string, input_hash string, "
    "query string, result_ids array<string>, memory_ids array<string>, "
    "ccr_ids array<string>, original_refs array<string>, tokens_before bigint, "
    "tokens_after bigint, tokens_saved bigint, compression_ratio double, "
    "compressed boolean, retrieved_original boolean, failed boolean, "
    "error_reason string, cache_hit boolean, timestamp timestamp_ntz, run_id string, "
    "event_type string"
)
FAILURES = (
    "failure_id string, scope_id string, operation string, content_type string, "
    "strategy string, ccr_id string, memory_id string, error_reason string, "
    "event_type string, created_at timestamp_ntz, metadata string"
)
