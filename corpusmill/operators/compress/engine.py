"""Compress a corpus of mixed types, and the strategy registry."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.compress import (
    code, command_output, conversation, json_doc, log, markdown, plain_text, rag_chunk, test_output,
)
from corpusmill.operators.compress.common import Facts, Strategy, line
from corpusmill.schemas import CONTENT_TYPES

DEFAULT_MAX_TOKENS = 2000
MODES = ("conservative", "auto")
# Types that are meant to use the plain text strategy.
PLAIN_TEXT_TYPES = ("file_summary", "unknown")


@dataclass(frozen=True)
class Entry:
    """A registered strategy: Column functions plus a version."""

    compress: Strategy
    version: str = "1.0.0"
    facts: Facts | None = None


STRATEGIES: dict[str, Entry] = {
    "test_output": Entry(test_output.compress, "1.0.0", test_output.facts),
    "log": Entry(log.compress, "1.0.0", log.facts),
    "command_output": Entry(command_output.compress, "1.0.0", command_output.facts),
    "code": Entry(code.compress, "1.0.0", code.facts),
    "json": Entry(json_doc.compress, "1.0.0", json_doc.facts),
    "markdown": Entry(markdown.compress, "2.0.0", markdown.facts),
    "plain_text": Entry(plain_text.compress, "1.0.0", plain_text.facts),
    "rag_chunk": Entry(rag_chunk.compress, "1.0.0", rag_chunk.facts),
    "conversation_history": Entry(conversation.compress, "1.0.0", conversation.facts),
}


def register_strategy(
    content_type: str, strategy: Strategy, version: str = "1.0.0", facts: Facts | None = None
) -> None:
    """The last registration of a type wins."""
    if content_type not in CONTENT_TYPES:
        raise ValueError(f"unknown content type: {content_type}")
    STRATEGIES[content_type] = Entry(strategy, version, facts)


def get_strategy(content_type: str) -> Entry | None:
    return STRATEGIES.get(content_type)


def has_strategy(content_type: str) -> bool:
    return content_type in STRATEGIES


def registered_types() -> list[str]:
    return list(STRATEGIES)


def resolved_type(content_type: Column) -> Column:
    """The type whose strategy is used; null where there is none."""
    plain = list(PLAIN_TEXT_TYPES) if "plain_text" in STRATEGIES else []
    own = [t for t in PLAIN_TEXT_TYPES if t in STRATEGIES]
    return F.when(content_type.isin(*STRATEGIES), content_type).when(
        content_type.isin(*[t for t in plain if t not in own]), F.lit("plain_text")
    )


def strategy_version(content_type: Column) -> Column:
    """Version of the strategy a type resolves to, empty where there is none."""
    resolved = resolved_type(content_type)
    version = F.lit(None).cast("string")
    for kind, entry in STRATEGIES.items():
        version = F.when(resolved == kind, entry.version).otherwise(version)
    return F.coalesce(version, F.lit(""))


RESULT = "struct<compressed_content:string,summary:string,warnings:array<string>>"


def apply_strategy(
    content: Column, content_type: Column, max_tokens: int, goal: Column,
    types: Sequence[str] | None = None,
) -> Column:
    """The result struct of the strategy a row's type resolves to, else null."""
    resolved = resolved_type(content_type)
    chosen = F.lit(None).cast(RESULT)
    for name, entry in STRATEGIES.items():
        if types is None or name in types:
            result = entry.compress(content, max_tokens, goal).cast(RESULT)
            chosen = F.when(resolved == name, result).otherwise(chosen)
    return chosen


def goal_of(docs: DataFrame) -> Column:
    return F.col("goal") if "goal" in docs.columns else F.lit(None).cast("string")


def compress(
    docs: DataFrame,
    max_tokens: int = DEFAULT_MAX_TOKENS,
    mode: str = "conservative",
    types: Sequence[str] | None = None,
) -> DataFrame:
    """Compress every document by its type, failing open per row.

    Input: content, content_type and optionally goal. The corpus is read once:
    one projection picks the strategy row by row, and there is no shuffle. A
    row without a strategy, or for which one gives nothing, keeps its text.
    Where a corpus is known to hold few types, ``types`` plans only those.
    """
    if mode in MODES:
        chosen = apply_strategy(
            F.col("content"), F.col("content_type"), max_tokens, goal_of(docs), types
        )
    else:
        chosen = F.lit(None).cast(RESULT)
    return finish(docs.withColumn("_r", chosen), mode)


def finish(staged: DataFrame, mode: str = "conservative") -> DataFrame:
    """Turn the result struct ``_r`` of every row into result columns."""
    content, kind = F.col("content"), F.col("content_type")
    staged = staged.withColumn("_type", resolved_type(kind))

    got = F.col("_r.compressed_content")
    lost = got.isNull() & content.isNotNull()
    emptied = (F.length(got) == 0) & (F.length(content) > 0)
    failed = lost | emptied
    reason = (
        F.when(F.lit(mode not in MODES), F.lit(f'Invalid strategy mode: "{mode}"'))
        .when(F.col("_type").isNull(), F.concat(
            F.lit("Compression strategy not registered for content type: "), kind))
        .when(emptied, "empty_compression_output")
        .otherwise("compression_failed")
    )
    version = strategy_version(kind)
    strategy = F.concat(
        F.col("_type"), F.lit(f"_{mode}_v"), F.substring_index(version, ".", 1)
    )
    staged = staged.withColumns(
        {
            "failed": failed,
            "error_reason": F.when(failed, reason),
            "compressed_content": F.when(failed, content).otherwise(got),
            "tokens_before": T.token_count(content),
            "strategy": F.when(failed, "").otherwise(strategy),
            "strategy_version": F.when(failed, "").otherwise(version),
        }
    ).withColumn("tokens_after", T.token_count(F.col("compressed_content")))
    saved = T.tokens_saved(F.col("tokens_before"), F.col("tokens_after"))
    staged = staged.withColumn("tokens_saved", saved)
    ratio = T.compression_ratio(F.col("tokens_before"), F.col("tokens_saved"))
    staged = staged.withColumn("compression_ratio", ratio)
    percent = F.floor(F.col("compression_ratio") * 100 + 0.5)
    fell_back = (F.col("_type") != kind) & (kind != "plain_text")
    notes = F.concat(
        F.array(line("strategy=", F.col("strategy"))),
        F.coalesce(F.col("_r.warnings"), F.array().cast("array<string>")),
        F.array_compact(
            F.array(
                F.when(fell_back, line('No strategy registered for "', kind, '", fell back to plain_text')),
                F.when(
                    F.col("tokens_saved") > 0,
                    line("Token savings: ", F.col("tokens_before"), " → ", F.col("tokens_after"), " (",
                         F.col("tokens_saved"), " saved, ", percent, "% reduction)"),
                ),
            )
        ),
    )
    open_note = F.array(F.lit("Compression failed open and returned original content."))
    return staged.withColumns(
        {
            "summary": F.when(~F.col("failed"), F.col("_r.summary")),
            "warnings": F.when(F.col("failed"), open_note).otherwise(notes),
            "compressed": F.col("tokens_saved") > 0,
        }
    ).drop("_r", "_type")


def type_facts(docs: DataFrame, content_type: str) -> DataFrame:
    """Facts table of the documents of one type: one row per (kind, ord, value)."""
    entry = STRATEGIES[content_type]
    if entry.facts is None:
        raise ValueError(f"no facts for content type: {content_type}")
    keys = [c for c in ("scope_id", "doc_id") if c in docs.columns]
    rows = docs.filter(F.col("content_type") == content_type)
    return rows.select(*keys, F.explode(entry.facts(F.col("content"))).alias("_f")).select(*keys, "_f.*")
