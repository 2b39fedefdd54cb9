"""Shortcuts of the compressors against the plain rules."""

import random
import re

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.compress import common, markdown, plain_text


def mixed(rng, pieces, n):
    return "".join(rng.choice(pieces) + rng.choice([" ", "", "_", ".", "\t"]) for _ in range(rng.randint(0, n)))


def test_signals_and_structured_lines(spark):
    rng = random.Random(3)
    pieces = ["Error", "unable", "stack trace", "WARN", "warnings", "note", "keys", "GET /a", "/api/x", "5 ms", "5x", "<= 3", "npm install x", "go", "FOO:", "a.b=", "`A_B`", "`x`", "Rollback", "- item", "日本"]
    rows = spark.createDataFrame([(mixed(rng, pieces, 4),) for _ in range(2000)], "x string")
    x, low = F.col("x"), F.lower("x")
    signal = F.lit(0)
    for value, patterns in reversed(plain_text.SIGNALS.items()):
        signal = F.when(x.rlike("|".join(T.ascii_words(p) for p in patterns)), value).otherwise(signal)
    plain = F.lit(False)
    for _, pattern in markdown.STRUCTURED:
        plain = plain | x.rlike(pattern)
    got = rows.select(
        (plain_text._signal(x) == signal).alias("a"), (markdown._is_structured(x, low) == plain).alias("b"),
        (markdown._is_priority(x, low) == x.rlike(markdown.PRIORITY)).alias("c"))
    assert got.filter("NOT (a AND b AND c)").count() == 0


def sections(lines):
    out, title, level, start, body, fence = [], markdown.INTRO, 1, 0, [], False
    for k, line in [*enumerate(lines), (len(lines), None)]:
        fence ^= line is not None and line.strip().startswith("```")
        head = None if line is None or fence else re.search(r"^(#{1,6})\s+(.+)$", line)
        if line is None or head:
            if title != markdown.INTRO or any(b.strip() for b in body):
                out.append((title, level, start, k - 1, body))
            if head:
                title, level, start, body = head[2].strip(), len(head[1]), k, []
        else:
            body = [*body, line]
    return out


def test_markdown_sections(spark):
    rng = random.Random(4)
    pool = ["# A", "## B c", "text", "", "  ", "```", " ```js", "#no", "# " + markdown.INTRO, "####### seven"]
    docs = [[rng.choice(pool) for _ in range(rng.randint(1, 14))] for _ in range(400)] + [[""]]
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(docs)] + [(-1, None)], "k int, ls array<string>")
    for r in rows.withColumn("s", markdown.parse_sections(F.col("ls"))).collect():
        assert (r.s and [tuple(s) for s in r.s]) == (None if r.ls is None else sections(r.ls)) or (r.s == [] == sections(r.ls))


def test_renderings_that_cannot_fit_are_left_out(spark):
    """The first two steps would be too long, which is known beforehand; they would also fail."""
    steps = [{"n": 1000}, {"n": 500}, {"n": 3}, {"n": 2}]
    render = lambda s: F.when(s["n"] > 100, F.raise_error(F.lit("rendered")).cast("string")).otherwise(F.repeat(F.lit("x"), s["n"]))
    one = spark.range(1).select(F.col("id"))
    assert one.select(common.ladder(steps, render, 1, lambda s: s["n"] + F.col("id")).alias("t")).first().t == "xxx"
    assert one.select(common.ladder([{"n": 1000}], lambda s: F.repeat(F.lit("x"), s["n"]), 1, lambda s: s["n"] + F.col("id")).alias("t")).first().t == "xxxx"
