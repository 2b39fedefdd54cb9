"""Literals that stand before patterns, and shortcuts, against the plain rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import analyze as N

W, NW = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
ERRORS = [
    rf"(?i){W}(?:error|exception|fail|crash|panic|fatal|abort|timeout){NW}", rf"(?i){W}(?:syntax\s*error|type\s*error|reference\s*error|range\s*error){NW}",
    rf"{W}(?:E\d{{4,}}|0x[0-9A-Fa-f]{{8}}){NW}", rf"(?i){W}assert(?:ion)?\s*(?:failed|error){NW}", r"\[ERROR\]|\[FATAL\]|\[CRITICAL\]|\[WARN\]",
    r"(?i)Traceback\s*\(most\s+recent\s+call\s+last\)", r"^\s*at\s+\S+\s+\(.*:\d+:\d+\)", r"(?i)Caused by:", r"(?i)Exit\s*code:\s*[1-9]",
]


def mixed(rng, pieces, n):
    return "".join(rng.choice(pieces) + rng.choice([" ", "", "_", ".", "\t"]) for _ in range(rng.randint(0, n)))


def test_error_lines(spark):
    rng = random.Random(1)
    pieces = ["Error", "errorCode", "FAIL", "failed", "assertion", "type", "E1234", "E123", "0xDEADbeef", "[WARN]", "[warn]", "Traceback", "(most recent call last)",
              "at f", "(a.ts:1:2)", "caused by:", "exit code: 1", "exit code: 0", "timeouts", "x"]
    lines = [mixed(rng, pieces, 4) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", N._is_error(F.col("x")).alias("e")).collect()
    assert [r.x for r in rows if r.e != any(re.search(p, r.x) for p in ERRORS)] == []
    assert 500 < sum(r.e for r in rows) < 2500


def test_recall_and_other_patterns_need_their_literals(spark):
    rng = random.Random(2)
    pieces = "RULE best practice code style CLAUDE.md must not be bug previously bug still error known issue #12 a#12 current task what are we doing continue pick up where did you leave dependenc API breaking change schema how does it connect".split()
    texts = [mixed(rng, pieces, 6) for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    for group in (N.RULE_PATTERNS, N.BUG_PATTERNS, N.TASK_PATTERNS, N.ARCHITECTURE_PATTERNS):
        got = rows.select(N._any(F.col("x"), group, F.lower("x")).alias("a"), N._any(F.col("x"), group).alias("b"))
        assert got.filter("a != b").count() == 0 and 0 < got.filter("a").count() < 2000


@pytest.mark.parametrize("text", [None, "", " ", "　\n\t﻿", " a ", " x", "x ", "\x1c"])
def test_blank(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(T.is_blank(F.col("t")).alias("b")).first().b
    assert got == (text is None or not text.strip(T.WHITESPACE))
