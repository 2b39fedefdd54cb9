"""L3 and L4: test runner output by failed tests and overall status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import WORD_END as WE
from corpusmill.functions.text import WORD_START as WS
from corpusmill.functions.text import let, strip_ansi, token_count, trim
from corpusmill.operators.compress.common import (
    budgeted, extract, facts_of, first_of, head, ladder, last_of, line, lines_of, one, or_else,
    result, tail, texts, when_lines,
)

# What is picked out of test output.
FRAMEWORKS = {
    "vitest": r"(?i)vitest\s+v?[\d.]+",
    "jest": rf"(?i){WS}jest{WE}",
    "pytest": rf"(?i){WS}pytest{WE}",
    "mocha": rf"(?i){WS}mocha{WE}",
}
FILE_HEADER = r"^\s*(?:FAIL|❯)\s+(.+\.(?:test|spec)\.\w+)"
FAILED_TEST = r"^\s*(?:×|✗|✘)\s+(.+)$"
SINGLE_FAIL = r"^\s*(?:FAIL|×)\s+(.+)$"
ERROR_LINE = r"(?i)^\s*(?:Error|TypeError|AssertionError|ReferenceError|RangeError)[: ]\s*(.+)"
ERROR_TYPE = r"(?i)^([A-Za-z]+)[: ]"
EXPECTED = r"(?i)Expected[: ]\s*(.+)"
RECEIVED = r"(?i)Received[: ]\s*(.+)"
FRAME = r"^\s*(?:at |❯ |→ )"
LOCATION = r"^\s*(?:❯ |at )?(.+?\.\w+:\d+:\d+)"
COMMAND = r"^\s*[>$]\s+(.+)"
RUN = r"(?:RUN|run|Running)\s+(.+)"
EXIT_CODE = rf"(?i){WS}exit\s*code\s*[:=]?\s*(-?\d+)"
SUREFIRE = r"(?i)Tests run:\s*\d+\s*,\s*Failures:\s*(\d+)\s*,\s*Errors:\s*(\d+)\s*,\s*Skipped:\s*\d+"
MAVEN_FAILURE = r"(?i)BUILD FAILURE|<<<\s+(?:FAILURE|ERROR)!"
SUCCESS = rf"(?i)BUILD SUCCESS|Tests? (?:all )?passed|All tests passed|{WS}SUCCESSFUL{WE}"
LOOK_AHEAD = 39


def _failures(ls: Column) -> Column:
    """(at, file, name) of every failed test under the file header above it."""
    empty = F.array().cast("array<struct<at:int,file:string,name:string>>")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("file"), empty.alias("found"))

    def step(s: Column, x: Column) -> Column:
        header = trim(F.regexp_extract(x, FILE_HEADER, 1))
        name = trim(F.regexp_extract(x, FAILED_TEST, 1))
        single = trim(F.regexp_extract(x, SINGLE_FAIL, 1))
        is_header = F.length(header) > 0
        is_test = ~is_header & (F.length(s["file"]) > 0) & (F.length(name) > 0)
        opens = ~is_header & (F.length(s["file"]) == 0) & (F.length(single) > 0)
        file = F.when(is_header, header).when(opens, single).otherwise(s["file"])
        entry = F.struct(s["at"].alias("at"), s["file"].alias("file"), name.alias("name"))
        return F.struct(
            (s["at"] + 1).alias("at"),
            file.alias("file"),
            F.when(is_test, F.array_append(s["found"], entry)).otherwise(s["found"]).alias("found"),
        )

    return F.aggregate(ls, state, step, lambda s: s["found"])


def _detail(ls: Column, f: Column) -> Column:
    """The failure's error, values, location and frames from the next 39 lines."""

    def look(w: Column) -> Column:
        errors = F.filter(w, lambda x: x.rlike(ERROR_LINE))
        kind = F.regexp_extract(first_of(errors), ERROR_TYPE, 1)
        return F.struct(
            f["file"].alias("file"),
            f["name"].alias("name"),
            F.when(F.size(errors) > 0, or_else(kind, "Error")).otherwise("").alias("error_type"),
            F.regexp_extract(first_of(errors), ERROR_LINE, 1).alias("error_message"),
            trim(first_of(extract(w, EXPECTED))).alias("expected"),
            trim(first_of(extract(w, RECEIVED))).alias("received"),
            first_of(extract(w, LOCATION)).alias("location"),
            F.filter(w, lambda x: x.rlike(FRAME)).alias("stack"),
        )

    return let(F.slice(ls, f["at"] + 2, F.lit(LOOK_AHEAD)), look)


def status(content: Column, exit_code: Column, failures: Column) -> Column:
    """L4: failure evidence before any success signal."""
    last_failures = last_of(F.regexp_extract_all(content, F.lit(SUREFIRE), 1))
    last_errors = last_of(F.regexp_extract_all(content, F.lit(SUREFIRE), 2))
    some = lambda c: F.coalesce(c.try_cast("int"), F.lit(0)) > 0
    return (
        F.when((F.length(exit_code) > 0) & (exit_code.try_cast("int") != 0), "FAILED")
        .when(content.rlike(MAVEN_FAILURE), "FAILED")
        .when(some(last_errors) | some(last_failures), "FAILED")
        .when(failures > 0, "FAILED")
        .when(content.rlike(SUCCESS), "PASSED")
        .when(F.length(last_failures) > 0, "PASSED")
        .otherwise("UNKNOWN")
    )


def extract_info(text: Column) -> Column:
    def build(ls: Column) -> Column:
        framework = F.lit("unknown")
        for name, pattern in reversed(FRAMEWORKS.items()):
            framework = F.when(text.rlike(pattern), name).otherwise(framework)
        by_prompt = trim(first_of(extract(head(ls, 20), COMMAND)))
        command = F.when(F.length(by_prompt) > 0, by_prompt).otherwise(
            trim(F.regexp_extract(text, RUN, 1))
        )
        failed = let(_failures(ls), lambda fs: F.transform(fs, lambda f: _detail(ls, f)))
        exit_code = last_of(F.regexp_extract_all(text, F.lit(EXIT_CODE), 1))
        return F.struct(
            command.alias("command"),
            framework.alias("framework"),
            exit_code.alias("exit_code"),
            failed.alias("failed"),
            tail(F.filter(ls, lambda x: F.length(trim(x)) > 0), 10).alias("last"),
        )

    return let(F.split(text, "\n"), build)


def _failed_lines(failed: Column) -> Column:
    def lines_for(f: Column, i: Column) -> Column:
        return F.concat(
            texts(line("  ", i + 1, ". **", f["file"], "** > `", f["name"], "`")),
            when_lines(F.length(f["error_type"]) > 0, texts(line(
                "     - Error: `", f["error_type"], "`: ", f["error_message"]))),
            when_lines(F.length(f["expected"]) > 0, texts(line("     - Expected: `", f["expected"], "`"))),
            when_lines(F.length(f["received"]) > 0, texts(line("     - Received: `", f["received"], "`"))),
            when_lines(F.length(f["location"]) > 0, texts(line("     - Location: `", f["location"], "`"))),
        )

    return F.flatten(F.transform(failed, lines_for))


MANY = 1_000_000
# Frames, last lines and tests of ever shorter renderings.
STEPS = ((MANY, 10, MANY), (10, 10, MANY), (5, 5, MANY), (3, 3, MANY), (0, 0, 1))


def render(i: Column, state: Column, limits: Column) -> Column:
    frames, last = limits["frames"], limits["last"]
    failed = head(i["failed"], limits["tests"])
    first = F.get(i["failed"], F.lit(0))
    get = lambda name: F.coalesce(first[name], F.lit(""))
    stack = F.coalesce(first["stack"], F.array().cast("array<string>"))
    shown = head(stack, F.least(frames, F.lit(20)))
    more = F.size(stack) - 20
    n = F.size(i["failed"])
    listed = F.concat(
        texts(line("- **Failed Tests:** ", F.size(failed))), _failed_lines(failed)
    )
    return lines_of(
        texts("## Test Output Summary", "",
              line("- **Command:** ", or_else(i["command"], "(not detected)")),
              line("- **Framework:** ", i["framework"]),
              line("- **Status:** ", state)),
        F.when(n > 0, listed).otherwise(texts("- **Failed Tests:** None detected")),
        when_lines(n > 0, texts(line("- **Key Error:** ", get("error_type"), ": ", get("error_message")))),
        when_lines(F.length(get("expected")) > 0, texts(line("- **Expected:** `", get("expected"), "`"))),
        when_lines(F.length(get("received")) > 0, texts(line("- **Received:** `", get("received"), "`"))),
        when_lines(F.size(shown) > 0, F.concat(
            texts("- **Stack Trace:**", "  ```"),
            F.transform(shown, lambda x: F.concat(F.lit("  "), trim(x))),
            when_lines((more > 0) & (frames > 20), texts(line("  ... (", more, " more frames)"))),
            texts("  ```"))),
        texts(line("- **Exit Code:** ", or_else(i["exit_code"], "(not detected)"))),
        when_lines((F.size(i["last"]) > 0) & (last > 0), F.concat(
            texts("- **Last Lines:**", "  ```"),
            F.transform(tail(i["last"], last), lambda x: F.concat(F.lit("  "), x)),
            texts("  ```"))),
    )


def compress(content: Column, max_tokens: int, goal: Column) -> Column:
    def run(text: Column) -> Column:
        def with_info(i: Column) -> Column:
            state = status(text, i["exit_code"], F.size(i["failed"]))

            def finish(st: Column) -> Column:
                first = F.get(i["failed"], F.lit(0))
                summary = F.when(
                    F.size(i["failed"]) == 0,
                    line("Test output compressed — status: ", st, ", framework: ", i["framework"]),
                ).otherwise(
                    line(first["file"], " > ", first["name"], " failed — ", first["error_type"], ": ",
                         first["error_message"])
                )
                steps = [dict(zip(("frames", "last", "tests"), v)) for v in STEPS]
                text = ladder(steps, lambda limits: render(i, st, limits), max_tokens)
                return let(text, lambda t: result(t, summary, F.when(
                    token_count(t) >= max_tokens, line("Trimmed to fit ", F.lit(max_tokens), " token budget"))))

            return let(state, finish)

        return let(extract_info(text), with_info)

    return budgeted(content, max_tokens, "Test output", let(strip_ansi(content), run))


def facts(content: Column) -> Column:
    def rows(text: Column) -> Column:
        def from_info(i: Column) -> Column:
            failed = F.transform(
                i["failed"],
                lambda f: F.concat_ws("|", f["file"], f["name"], f["error_type"], f["error_message"],
                                      f["expected"], f["received"], f["location"]),
            )
            return facts_of(
                command=one(i["command"]), framework=F.array(i["framework"]),
                status=F.array(status(text, i["exit_code"], F.size(i["failed"]))),
                exit_code=one(i["exit_code"]), failed_test=failed,
            )

        return let(extract_info(text), from_info)

    return let(strip_ansi(content), rows)
