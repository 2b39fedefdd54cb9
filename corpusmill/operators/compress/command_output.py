"""Command output by errors, exit code and the last lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import WORD_END as WE
from corpusmill.functions.text import WORD_START as WS
from corpusmill.functions.text import let, token_count, trim, truncate_to_tokens
from corpusmill.operators.compress.common import (
    budgeted, extract, facts_of, first_of, head, line, lines_of, one, or_else, result, tail, texts,
    when_lines,
)

# What is picked out of command output.
COMMAND = r"^\s*[>$]\s+(.+)"
EXIT_CODE = r"(?i)exit\s*code[: ]?\s*(\d+)"
FAILED_EXIT = r"(?i)(?:failed|exited)\s+with\s+(?:exit\s+)?code\s+(\d+)"
TS_ERROR = r"(?i)^(.+?)\((\d+),(\d+)\):\s*error\s+(\w+)[: ]?\s*(.*)"
FILE_ERROR = (
    r"(?i)([/\w.-]+\.[a-z]{2,6})\s*[\(\[](?:(\d+)[,:]?(?:(\d+))?)?[\)\]]?\s*:\s*"
    r"error\s+(\w+)[: ]?\s*(.*)"
)
PROGRESS_BAR = r"[\[=]+\s*[>]*\s*[=\]]+|[\|\\/\-]"
PERCENT = rf"{WS}\d{{1,3}}%(?=[A-Za-z0-9_])"
SPINNER = r"[\|\\/\-⠀-⣿◐-◿]"
INSTALL = r"(?i)(?:npm|pnpm|yarn|pip|cargo|go)\s+(?:install|add|get|download)"


def _errors(ls: Column) -> Column:
    """Compiler errors, distinct by file, line and code."""

    def parse(x: Column) -> Column:
        is_ts = x.rlike(TS_ERROR)

        def part(group: int) -> Column:
            return F.when(is_ts, F.regexp_extract(x, TS_ERROR, group)).otherwise(
                F.regexp_extract(x, FILE_ERROR, group)
            )

        return F.when(
            is_ts | x.rlike(FILE_ERROR),
            F.struct(
                part(1).alias("file"), part(2).alias("line"), part(3).alias("col"),
                part(4).alias("code"), part(5).alias("message"),
            ),
        )

    def distinct(found: Column) -> Column:
        keys = F.transform(found, lambda e: F.concat_ws(":", e["file"], e["line"], e["code"]))
        return let(
            keys,
            lambda k: F.filter(found, lambda _e, i: F.array_position(k, F.get(k, i)) == i + 1),
        )

    return let(F.array_compact(F.transform(ls, parse)), distinct)


def _is_noise(x: Column) -> Column:
    t = trim(x)
    progress = x.rlike(PROGRESS_BAR) & x.rlike(PERCENT)
    spinner = (F.length(t) <= 3) & t.rlike(SPINNER)
    return (progress | x.rlike(INSTALL) | spinner) & ~F.lower(x).contains("error")


def extract_info(ls: Column) -> Column:
    low = lambda x: F.lower(x)
    codes = F.transform(
        ls,
        lambda x: F.coalesce(
            F.nullif(F.regexp_extract(x, EXIT_CODE, 1), F.lit("")),
            F.regexp_extract(x, FAILED_EXIT, 1),
        ),
    )
    failed = F.filter(ls, lambda x: low(x).contains("build failed") | low(x).contains("command failed"))
    filled = F.filter(ls, lambda x: F.length(trim(x)) > 0)
    guesses = F.filter(
        F.transform(head(ls, 5), trim),
        lambda t: ~t.startswith(">") & (F.length(t) > 3) & (F.length(t) < 200),
    )
    command = first_of(F.transform(extract(ls, COMMAND), trim))
    return F.struct(
        or_else_column(command, first_of(guesses)).alias("command"),
        first_of(F.filter(codes, lambda c: F.length(c) > 0)).alias("exit_code"),
        F.filter(ls, lambda x: low(x).contains("stderr")).alias("stderr"),
        trim(first_of(failed)).alias("failure"),
        _errors(ls).alias("errors"),
        tail(filled, 15).alias("last"),
        F.size(F.filter(ls, _is_noise)).alias("folded"),
    )


def or_else_column(text: Column, other: Column) -> Column:
    return F.when(F.length(text) > 0, text).otherwise(other)


def _error_row(e: Column) -> Column:
    short = F.array_join(tail(F.split(e["file"], r"[/\\]"), 2), "/")
    message = F.regexp_replace(F.substring(e["message"], 1, 80), r"([|\\])", r"\\$1")
    return line("| `", short, "` | ", e["line"], ":", e["col"], " | `", e["code"], "` | ", message, " |")


def render(i: Column) -> Column:
    n, m = F.size(i["errors"]), F.size(i["stderr"])
    return lines_of(
        texts("## Command Output Summary", ""),
        texts(line("- **Command:** `", or_else(i["command"], "(not detected)"), "`"),
              line("- **Exit Code:** ", or_else(i["exit_code"], "(not detected)"))),
        when_lines(F.length(i["failure"]) > 0, texts(line("- **Failure:** ", i["failure"]))),
        texts(""),
        when_lines(n > 0, F.concat(
            texts(line("### Errors (", n, ")"), "", "| File | Line | Code | Message |", "|------|------|------|---------|"),
            F.transform(head(i["errors"], 30), _error_row),
            when_lines(n > 30, texts(line("| ... | ... | ... | *(", n - 30, " more errors)* |"))),
            texts(""))),
        when_lines(m > 0, F.concat(
            texts("### Stderr", "```"), head(i["stderr"], 30),
            when_lines(m > 30, texts(line("... (", m - 30, " more stderr lines)"))),
            texts("```", ""))),
        when_lines(i["folded"] > 0, texts(line("- **Progress/Install Lines Folded:** ", i["folded"]), "")),
        when_lines(F.size(i["last"]) > 0, F.concat(texts("### Last Output", "```"), i["last"], texts("```"))),
    )


def compress(content: Column, max_tokens: int, goal: Column) -> Column:
    def run(i: Column) -> Column:
        def finish(text: Column) -> Column:
            fits = token_count(text) <= max_tokens
            return result(
                F.when(fits, text).otherwise(truncate_to_tokens(text, max_tokens)),
                F.when(fits, line('Command output compressed: command="', i["command"], '", exit=', i["exit_code"]))
                .otherwise("Command output compressed and truncated"),
                F.when(fits & (i["folded"] > 0), line("Folded ", i["folded"], " progress/install lines")),
                F.when(~fits, line("Trimmed to fit ", F.lit(max_tokens), " token budget")),
            )

        return let(render(i), finish)

    body = let(F.split(content, "\n"), lambda ls: let(extract_info(ls), run))
    return budgeted(content, max_tokens, "Command output", body)


def facts(content: Column) -> Column:
    def rows(i: Column) -> Column:
        errors = F.transform(
            i["errors"],
            lambda e: F.concat_ws("|", e["file"], e["line"], e["col"], e["code"], e["message"]),
        )
        return facts_of(
            command=one(i["command"]), exit_code=one(i["exit_code"]), failure=one(i["failure"]),
            error=errors, stderr=i["stderr"], folded_lines=F.array(i["folded"].cast("string")),
        )

    return let(F.split(content, "\n"), lambda ls: let(extract_info(ls), rows))
