"""Judging what the compressors really write (Q1, Q2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import quality
from corpusmill.operators.compress import compress
from corpusmill.operators.compress.engine import DEFAULT_MAX_TOKENS
from corpusmill.session import written


def judge_compression(
    docs: DataFrame,
    expectations: DataFrame,
    originals: DataFrame,
    max_tokens: int = DEFAULT_MAX_TOKENS,
    compressor: Callable[[DataFrame, int], DataFrame] = compress,
) -> DataFrame:
    """Q1 and Q2 of every document, compressed here: facts kept, and the checks of the gate.

    ``docs``: case_id, content, content_type and optionally goal;
    ``expectations``: case_id, key_facts, must_keep, must_not_invent,
    min_savings; ``originals``: case_id with the stored content. Facts are
    looked for in the whole output, expected against the whole input. A
    document without expectations has no row. The results are written once, as
    both judgements read them.
    """
    results = compressor(docs, max_tokens).select(
        "case_id", "content_type", "compressed_content", "tokens_before", "tokens_saved", "compression_ratio", "failed"
    )
    results = written(results, "judged")
    expected = expectations.join(docs.select("case_id", "content"), "case_id")
    kept = quality.key_fact_retention(results, expectations)
    gate = quality.compression_gate(results, expected, originals).drop("content_type")
    return kept.join(gate, "case_id")
