"""The gate must tell a working compressor from ones that change nothing or keep nothing."""

from pyspark.sql import functions as F

from corpusmill.operators.compress import compress
from corpusmill.plans.gate import judge_compression

LINES = [f"2024-01-01T00:{k // 60:02d}:{k % 60:02d}Z INFO served page {k}" for k in range(300)]
LINES[40] = "2024-01-01T00:00:40Z ERROR disk full at src/store.ts:12"
LINES[290] = "2024-01-01T00:04:50Z FATAL gave up trace_id=abc-1"


def _judge(spark, compressor, stored=None):
    log = "\n".join(LINES)
    docs = spark.createDataFrame([(1, log, "log"), (2, None, "log"), (3, "", "log")], "case_id long, content string, content_type string")
    facts = [LINES[40], LINES[290]]
    cases = [(1, facts, facts, ["never said"], None), (2, [], [], [], None), (3, [], [], [], 0.0)]
    expectations = spark.createDataFrame(
        cases, "case_id long, key_facts array<string>, must_keep array<string>, must_not_invent array<string>, min_savings double")
    originals = spark.createDataFrame([(1, stored or log), (3, "")], "case_id long, content string")
    return {r.case_id: r for r in judge_compression(docs, expectations, originals, 400, compressor).collect()}


def test_gate_passes_the_log_compressor(spark):
    rows = _judge(spark, compress)
    assert (rows[1].facts_retained, rows[1].retention_rate, rows[1].saves_enough, rows[1].passed) == (2, 1.0, True, True)
    assert set(rows) == {1, 2, 3} and not rows[2].passed


def test_gate_fails_identity_empty_and_lost_originals(spark):
    changed = lambda how: lambda docs, budget: compress(docs, budget).withColumns(how)
    same = _judge(spark, changed({"compressed_content": F.col("content"), "tokens_saved": F.lit(0).cast("bigint")}))[1]
    assert same.keeps_facts and not same.saves_enough and not same.passed
    empty = _judge(spark, changed({"compressed_content": F.lit(""), "tokens_saved": F.col("tokens_before")}))[1]
    assert empty.facts_retained == 0 and not empty.keeps_facts and not empty.passed
    invented = _judge(spark, changed({"compressed_content": F.concat("compressed_content", F.lit("never said"))}))[1]
    assert not invented.invents_nothing and not invented.passed
    lost = _judge(spark, compress, stored="another text")[1]
    assert not lost.recoverable and not lost.passed
