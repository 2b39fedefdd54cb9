"""The line table of a corpus and the window operators over it.

A document is one input row, so a window over its lines is bounded by the size
of one document. All windows share one shuffle by document. The compressors
need no line table: they fold arrays inside the document's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import WORD_END as WE
from corpusmill.functions.text import WORD_START as WS
from corpusmill.functions.text import let, section_key, token_count, trim

DOC = ("scope_id", "doc_id")


def lines(docs: DataFrame, content: str = "content") -> DataFrame:
    """(scope_id, doc_id, line_no, line), line_no from 0."""
    return docs.select(*DOC, F.posexplode(F.split(content, "\n")).alias("line_no", "line"))


def _in_order() -> "Window":
    return Window.partitionBy(*DOC).orderBy("line_no")


def _running(condition: Column, include_current: bool = True) -> Column:
    end = Window.currentRow if include_current else -1
    window = _in_order().rowsBetween(Window.unboundedPreceding, end)
    return F.coalesce(F.sum(condition.cast("int")).over(window), F.lit(0))


# What makes a log line a priority line, a stack frame, a heartbeat.
PRIORITY_LEVELS = ("FATAL", "ERROR", "WARN", "EXCEPTION", "TRACEBACK")
STACK_FRAME = r"^\s+at\s+.+?:\d+:\d+"
CAUSED_BY = r"(?i)^\s*(?:Caused by|Triggered by):\s*"
HEARTBEAT = rf"(?i){WS}(?:heartbeat|ping|keep-?alive|healthcheck){WE}"
TIMESTAMP = rf"{WS}(\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?Z?){WE}"


def is_priority(line: Column) -> Column:
    return F.upper(line).rlike("|".join(PRIORITY_LEVELS))


def is_info(line: Column) -> Column:
    return F.upper(line).rlike("INFO|DEBUG") & ~is_priority(line)


def is_heartbeat(line: Column) -> Column:
    return line.rlike(HEARTBEAT) & ~is_priority(line)


def is_frame(line: Column) -> Column:
    return line.rlike(STACK_FRAME) | line.rlike(CAUSED_BY)


def ends_stack(line: Column) -> Column:
    """A blank or priority line closes the stack block open at it."""
    return line.rlike(r"\A\s*\z") & ~is_frame(line) | is_priority(line)


def fold_repeats(sections: DataFrame) -> DataFrame:
    """Runs of three or more equal sections become one plus a marker.

    Input and output are (scope_id, doc_id, line_no, line), one row a section.
    """
    key = section_key(F.col("line"))
    keyed = sections.withColumn("_key", key)
    changed = ~F.lag("_key").over(_in_order()).eqNullSafe(F.col("_key"))
    keyed = keyed.withColumn("_changed", changed).withColumn("_run", _running(F.col("_changed")))
    runs = keyed.groupBy(*DOC, "_run").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("line_no").alias("start"),
        F.min_by("line", "line_no").alias("first"),
        F.max_by("line", "line_no").alias("last"),
    )
    marker = repeat_marker(F.col("n"))
    kept = (
        F.when(F.col("n") > 2, F.array("first", marker))
        .when(F.col("n") == 2, F.array("first", "last"))
        .otherwise(F.array("first"))
    )
    return runs.select(*DOC, "start", F.posexplode(kept).alias("offset", "line")).select(
        *DOC, (F.col("start") + F.col("offset")).alias("line_no"), "line"
    )


def repeat_marker(n: Column) -> Column:
    return F.concat(F.lit("[↑ Repeated "), n, F.lit(" times — folded to save tokens]"))


def folded_counts(line_table: DataFrame) -> DataFrame:
    """INFO/DEBUG lines beyond 3 and heartbeats beyond 2 of every run, per document."""
    line = F.col("line")
    flagged = line_table.select(
        *DOC, "line_no", is_info(line).alias("_info"), is_heartbeat(line).alias("_beat")
    ).withColumns(
        {
            "_info_run": _running(~F.col("_info")),
            "_beat_run": _running(~F.col("_beat")),
        }
    )

    def folded(flag: str, run: str, keep: int, name: str) -> DataFrame:
        runs = flagged.filter(flag).groupBy(*DOC, run).agg(F.count(F.lit(1)).alias("n"))
        beyond = F.greatest(F.col("n") - keep, F.lit(0))
        return runs.select(*DOC, beyond.alias(name))

    info = folded("_info", "_info_run", 3, "folded_info")
    beats = folded("_beat", "_beat_run", 2, "folded_heartbeats")
    both = info.unionByName(beats, allowMissingColumns=True)
    return both.groupBy(*DOC).agg(
        F.coalesce(F.sum("folded_info"), F.lit(0)).alias("folded_info"),
        F.coalesce(F.sum("folded_heartbeats"), F.lit(0)).alias("folded_heartbeats"),
    )


def stack_blocks(line_table: DataFrame, head: int = 5, tail: int = 3, long: int = 8) -> DataFrame:
    """The frames to show of every stack block, with part 'top' or 'bottom'."""
    line = F.col("line")
    numbered = line_table.withColumn("_ends", ends_stack(line)).withColumn(
        "block", _running(F.col("_ends"), include_current=False)
    )
    frames = numbered.filter(is_frame(line))
    inside = Window.partitionBy(*DOC, "block").orderBy("line_no")
    from_end = Window.partitionBy(*DOC, "block").orderBy(F.col("line_no").desc())
    ranked = frames.withColumns(
        {
            "_first": F.row_number().over(inside),
            "_last": F.row_number().over(from_end),
        }
    ).withColumn("_n", F.col("_first") + F.col("_last") - 1)
    parts = F.filter(
        F.array(
            F.when(F.col("_first") <= head, "top"),
            F.when((F.col("_last") <= tail) & (F.col("_n") > long), "bottom"),
        ),
        lambda p: p.isNotNull(),
    )
    return ranked.select(*DOC, "line_no", "line", F.explode(parts).alias("part"))


def brace_depth(line_table: DataFrame, opening: str = "{", closing: str = "}") -> DataFrame:
    """E5: nesting depth after every line."""
    delta = F.regexp_count("line", F.lit("\\" + opening)) - F.regexp_count(
        "line", F.lit("\\" + closing)
    )
    window = _in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line_table.withColumn("_delta", delta).withColumn(
        "depth", F.sum("_delta").over(window)
    ).drop("_delta")


def time_range(line_table: DataFrame) -> DataFrame:
    """First and last timestamp in document order, one row per document."""
    stamp = F.regexp_extract("line", TIMESTAMP, 1)
    seen = line_table.withColumn("_at", stamp).filter(F.col("_at") != "")
    return seen.groupBy(*DOC).agg(
        F.min_by("_at", "line_no").alias("first_timestamp"),
        F.max_by("_at", "line_no").alias("last_timestamp"),
    )


HEADING = r"^(#{1,6})\s+(.+)$"


def markdown_sections(line_table: DataFrame) -> DataFrame:
    """The number of headings at or above every line, fences excluded."""
    fence = trim(F.col("line")).startswith("```")
    fenced = line_table.withColumn("_fence", fence).withColumn(
        "in_fence", _running(F.col("_fence")) % 2 == 1
    )
    heading = ~F.col("in_fence") & F.col("line").rlike(HEADING)
    return fenced.withColumn("is_heading", heading).withColumn(
        "section", _running(F.col("is_heading"))
    ).drop("_fence")


def fit_prefix(line_table: DataFrame, max_tokens: int) -> DataFrame:
    """Rows from the start while they fit; stops at the first that does not."""
    window = _in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line_table.withColumn(
        "tokens_so_far", F.sum(token_count(F.col("line"))).over(window)
    ).filter(F.col("tokens_so_far") <= max_tokens)


def sample_lines(content: Column, ratio: float = 0.2) -> Column:
    """Head, middle and tail share of the lines, none twice."""
    if ratio >= 1.0:
        return content
    if ratio <= 0:
        return F.lit("")

    def render(ls: Column) -> Column:
        n = F.size(ls)
        share = F.greatest(F.lit(1), F.floor(n * F.lit(ratio)).cast("int"))
        mid = F.floor(n / 2).cast("int") - F.floor(share / 2).cast("int")
        start = F.greatest(F.lit(0), mid)
        stop = F.least(n, mid + share)
        tail = F.greatest(F.lit(0), n - share)

        def in_middle(i: Column) -> Column:
            return (i >= share) & (i >= start) & (i < stop)

        def marker(part: str, a: Column, b: Column) -> Column:
            text = F.concat(
                F.lit(f"\n// ... [sampled: {part} section, lines "), a, F.lit("-"), b,
                F.lit("] ...\n"),
            )
            return F.array(text)

        return F.array_join(
            F.concat(
                F.slice(ls, F.lit(1), share),
                marker("middle", start, F.greatest(start, stop)),
                F.filter(ls, lambda _l, i: in_middle(i)),
                marker("tail", tail, n),
                F.filter(ls, lambda _l, i: (i >= share) & (i >= tail) & ~in_middle(i)),
            ),
            "\n",
        )

    return let(F.split(content, "\n"), render)
