"""L2: logs by priority lines, stack blocks and folded noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import WORD_END as WE
from corpusmill.functions.text import WORD_START as WS
from corpusmill.functions.text import let, token_count, trim, truncate_to_tokens
from corpusmill.operators import lines as X
from corpusmill.operators.compress.common import (
    budgeted, extract, facts_of, first_of, head, last_of, line, lines_of, none, one, result, tail,
    texts, when_lines,
)

# What is picked out of log lines.
TRACE_ID = rf"(?i){WS}(?:trace[_-]?id|request[_-]?id|correlation[_-]?id)[=:]\s*(\S+)"
EXCEPTION = rf"{WS}([A-Z][a-zA-Z]*(?:Error|Exception|Fault|Failure)){WE}"
FILE = r"(?i)(?:at |in |from )([/\w.-]+\.[a-z]{2,6}):(\d+)"


def stack_frames(ls: Column) -> Column:
    """E4 inside a row: struct(top, bottom), five first and three last frames of every block."""
    state = F.struct(none().alias("top"), none().alias("bottom"), none().alias("block"))

    def flush(s: Column, block: Column) -> Column:
        return F.struct(
            F.concat(s["top"], head(block, 5)).alias("top"),
            F.when(F.size(block) > 8, F.concat(s["bottom"], tail(block, 3)))
            .otherwise(s["bottom"])
            .alias("bottom"),
            none().alias("block"),
        )

    def step(s: Column, x: Column) -> Column:
        block = F.when(X.is_frame(x), F.array_append(s["block"], x)).otherwise(s["block"])
        open_ = F.struct(s["top"].alias("top"), s["bottom"].alias("bottom"), block.alias("block"))
        return F.when(X.ends_stack(x) & (F.size(block) > 0), flush(s, block)).otherwise(open_)

    return F.aggregate(ls, state, step, lambda s: flush(s, s["block"]))


def folded(ls: Column) -> Column:
    """E3 inside a row: struct(info, beats), lines beyond 3 and 2 of every run."""
    zero = F.lit(0)
    state = F.struct(
        zero.alias("info_run"), zero.alias("info"), zero.alias("beat_run"), zero.alias("beats")
    )

    def step(s: Column, x: Column) -> Column:
        info = F.when(X.is_info(x), s["info_run"] + 1).otherwise(0)
        beat = F.when(X.is_heartbeat(x), s["beat_run"] + 1).otherwise(0)
        return F.struct(
            info.alias("info_run"),
            (s["info"] + (info > 3).cast("int")).alias("info"),
            beat.alias("beat_run"),
            (s["beats"] + (beat > 2).cast("int")).alias("beats"),
        )

    return F.aggregate(ls, state, step, lambda s: F.struct(s["info"], s["beats"]))


def extract_info(ls: Column) -> Column:
    priority = F.filter(ls, X.is_priority)
    other = F.filter(ls, lambda x: ~X.is_priority(x) & (F.length(trim(x)) > 0))
    return F.struct(
        priority.alias("priority"),
        tail(other, 10).alias("context"),
        extract(ls, X.TIMESTAMP).alias("stamps"),
        F.array_distinct(extract(ls, TRACE_ID)).alias("trace_ids"),
        F.array_distinct(extract(priority, EXCEPTION)).alias("exceptions"),
        F.array_distinct(extract(ls, FILE)).alias("files"),
        stack_frames(ls).alias("stack"),
        folded(ls).alias("folded"),
    )


def _quoted(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")


def render(i: Column) -> Column:
    n = F.size(i["priority"])
    frames = F.concat(
        i["stack"]["top"],
        when_lines(
            F.size(i["stack"]["bottom"]) > 0,
            F.concat(texts("  ... (middle frames folded) ..."), i["stack"]["bottom"]),
        ),
    )
    return lines_of(
        texts("## Log Summary", ""),
        when_lines(F.size(i["stamps"]) > 0, texts(line(
            "- **Time Range:** `", first_of(i["stamps"]), "` → `", last_of(i["stamps"]), "`"))),
        when_lines(F.size(i["trace_ids"]) > 0, texts(line(
            "- **Trace/Request IDs:** ", _quoted(i["trace_ids"])))),
        when_lines(F.size(i["exceptions"]) > 0, texts(line(
            "- **Exception Types:** ", F.array_join(i["exceptions"], ", ")))),
        when_lines(F.size(i["files"]) > 0, texts(line(
            "- **Relevant Files:** ", _quoted(head(i["files"], 5))))),
        texts(""),
        when_lines(n > 0, F.concat(
            texts("### Priority Lines (ERROR / WARN / FATAL)", "```"),
            head(i["priority"], 100),
            when_lines(n > 100, texts(line("... (", n - 100, " more priority lines)"))),
            texts("```", ""))),
        when_lines(F.size(frames) > 0, F.concat(
            texts("### Stack Trace", "```"), head(frames, 30), texts("```", ""))),
        when_lines(i["folded"]["info"] > 0, texts(line(
            "- **INFO/DEBUG Lines Folded:** ", i["folded"]["info"]))),
        when_lines(i["folded"]["beats"] > 0, texts(line(
            "- **Heartbeat Lines Folded:** ", i["folded"]["beats"]))),
        texts("", "### Tail Context", "```"),
        i["context"],
        texts("```"),
    )


def compress(content: Column, max_tokens: int, goal: Column) -> Column:
    def run(i: Column) -> Column:
        def finish(text: Column) -> Column:
            fits = token_count(text) <= max_tokens
            return result(
                F.when(fits, text).otherwise(truncate_to_tokens(text, max_tokens)),
                F.when(fits, line("Log compressed: ", F.size(i["priority"]), " priority lines kept, ",
                                  i["folded"]["info"], " INFO/DEBUG folded"))
                .otherwise(line("Log compressed and truncated to ", F.lit(max_tokens), " tokens")),
                F.when(i["folded"]["info"] > 0, line("Folded ", i["folded"]["info"], " INFO/DEBUG lines")),
                F.when(i["folded"]["beats"] > 0, line("Folded ", i["folded"]["beats"], " heartbeat lines")),
                F.when(F.size(i["files"]) > 0, line("Referenced files: ", F.array_join(head(i["files"], 5), ", "))),
                F.when(~fits, line("Trimmed to fit ", F.lit(max_tokens), " token budget")),
            )

        return let(render(i), finish)

    body = let(F.split(content, "\n"), lambda ls: let(extract_info(ls), run))
    return budgeted(content, max_tokens, "Log", body)


def facts(content: Column) -> Column:
    def rows(i: Column) -> Column:
        return facts_of(
            priority_line=i["priority"], trace_id=i["trace_ids"], exception=i["exceptions"],
            file=i["files"], stack_top=i["stack"]["top"], stack_bottom=i["stack"]["bottom"],
            first_timestamp=one(first_of(i["stamps"])), last_timestamp=one(last_of(i["stamps"])),
            folded_info=F.array(i["folded"]["info"].cast("string")),
            folded_heartbeats=F.array(i["folded"]["beats"].cast("string")),
        )

    return let(F.split(content, "\n"), lambda ls: let(extract_info(ls), rows))


def sample_fallback(content: Column, max_tokens: int) -> Column:
    """Priority lines, then every k-th other line, cut to the budget."""

    def cut(ls: Column) -> Column:
        def build(other: Column) -> Column:
            every = F.greatest(F.lit(1), F.ceil(F.size(other) / 20).cast("int"))
            sampled = F.filter(other, lambda _x, i: i % every == 0)
            marker = texts(line("[... ", F.size(other) - F.size(sampled), " lines folded ...]"))
            kept = F.concat(F.filter(ls, X.is_priority), marker, sampled)
            return truncate_to_tokens(F.array_join(kept, "\n"), max_tokens)

        return let(F.filter(ls, lambda x: ~X.is_priority(x)), build)

    return let(F.split(content, "\n"), cut)
