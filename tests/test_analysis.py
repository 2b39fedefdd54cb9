"""Analysis of whole texts: each pattern is tested once, and a cheap test comes first."""

import re

from pyspark.sql import functions as F

from corpusmill.operators import analyze as N
from corpusmill.operators import route as R
from corpusmill.sources import testdata as td

LINES = [
    "plain words", "an ERROR here", "terror", "Syntax  Error", "syntaxerror", "code E1234", "code E12", "at 0xDEADBEEF now", "[CRITICAL] x", "[warn] x",
    "[WARN] x", "assertion failed", "AssertError", "Traceback (most recent call last)", "  at f (a.ts:1:2)", "at noon (x)", "Caused By: y",
    "exit code: 3", "Exit code: 0", "fatality", "timeout", "E1234x", "",
]
# how the lines were told before the look-ahead and the hints
PLAIN = (
    r"(?i:(?<![A-Za-z0-9_])(?:error|exception|fail|crash|panic|fatal|abort|timeout|syntax\s*error|type\s*error|reference\s*error|range\s*error)(?![A-Za-z0-9_]))"
    r"|(?<![A-Za-z0-9_])(?:E\d{4,}|0x[0-9A-Fa-f]{8})(?![A-Za-z0-9_])|(?i:(?<![A-Za-z0-9_])assert(?:ion)?\s*(?:failed|error)(?![A-Za-z0-9_]))"
    r"|\[ERROR\]|\[FATAL\]|\[CRITICAL\]|\[WARN\]|(?i:Traceback\s*\(most\s+recent\s+call\s+last\))|^\s*at\s+\S+\s+\(.*:\d+:\d+\)"
    r"|(?i:Caused by:)|(?i:Exit\s*code:\s*[1-9])"
)


def test_error_lines_are_those_of_the_plain_pattern(spark):
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(LINES)] + [(99, "\n".join(LINES)), (100, None)], "doc_id long, content string")
    found = {r.doc_id: r.d for r in docs.select("doc_id", N.content_metrics(F.col("content"))["error_density"].alias("d")).collect()}
    told = [bool(re.search(PLAIN, line)) for line in LINES]
    assert [found[i] for i in range(len(LINES))] == [float(t) for t in told]
    assert found[99] == sum(told) / len(LINES) and found[100] == 0.0


def test_a_decision_tests_each_pattern_once(spark):
    docs = spark.createDataFrame([(1, "we agreed; the root cause is a bug that was found")], "doc_id long, content string")
    saved = docs.select(N.should_save_memory(F.lit(""), F.col("content")).alias("d"))
    assert saved._jdf.queryExecution().analyzed().toString().count("reproduction") == 1
    assert saved.first().d.asDict() == {"value": True, "confidence": 0.4, "reasons": ["decision_or_rule", "bug_or_fix"]}
    asked = docs.select(N.should_retrieve_original(F.lit("expand the text"), F.col("content"), F.lit("log")).alias("d"))
    assert asked._jdf.queryExecution().analyzed().toString().count("compressed[-_]context") == 1
    assert asked.first().d.asDict() == {"value": True, "confidence": 0.67, "reasons": ["asks_for_original", "short_result"]}


def test_literals_of_case_sensitive_signals_are_looked_up_in_their_case(spark):
    docs = spark.createDataFrame([("error info warn debug TypeError",), ("ERROR at x, WARN, INFO and DEBUG",)], "content string")
    log = R.DETECTORS["log"]
    assert {s.name: s.needs for s in log.signals if s.exact}["ERROR"] == ("ERROR",)
    found = [r[0] for r in docs.select(R.matched_signals(F.col("content"), log)).collect()]
    assert found == [["error class"], ["ERROR", "WARN", "INFO", "DEBUG"]]


def test_texts_made_of_narrow_rows_are_many_tasks(spark, tmp_path):
    rows = spark.range(400).select(
        F.col("id").alias("event_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"),
        F.lit("error").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k":3}').alias("props"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    for docs, n in ((td.json_documents(spark, str(tmp_path)), 400), (td.as_documents(td.log_lines(spark, str(tmp_path))), 8)):
        tasks = docs.select(F.spark_partition_id().alias("task"), "doc_id").collect()
        assert len(tasks) == n and len({r.task for r in tasks}) > 1
