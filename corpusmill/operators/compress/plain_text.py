"""L1: plain text by scored sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import (
    ascii_words, is_blank, let, section_key, token_count, trim, truncate_to_tokens,
)
from corpusmill.operators.compress.common import STRINGS, line, result
from corpusmill.operators.lines import repeat_marker

# Words that make a section important, by level.
SIGNALS = {
    12: (
        r"(?i)\b(?:error|fail|fatal|exception|panic|crash|critical)\b",
        r"(?i)\b(?:cannot|unable|refused|timeout|rejected|denied|invalid)\b",
        r"(?i)\b(?:stack trace|traceback|backtrace)\b",
    ),
    8: (
        r"(?i)\b(?:warn(?:ing)?|alert|caution|attention|notice)\b",
        r"(?i)\b(?:deprecated|obsolete|outdated|unstable)\b",
    ),
    4: (
        r"(?i)\b(?:important|note|key|crucial|essential|significant)\b",
        r"(?i)\b(?:todo|fixme|hack|xxx|review)\b",
        r"(?i)\b(?:summary|overview|conclusion|result)\b",
    ),
}


def sections(content: Column) -> Column:
    """Paragraphs, or lines of a single block of five or more lines."""

    def split(text: Column) -> Column:
        unix = F.regexp_replace(text, "\r\n?", "\n")
        paragraphs = F.split(unix, "\n\n+")
        lines = F.split(text, "\n")
        filled = lambda a: F.filter(a, lambda x: F.length(x) > 0)
        return (
            F.when(F.length(text) == 0, F.array().cast(STRINGS))
            .when(F.size(paragraphs) > 1, filled(paragraphs))
            .when(F.size(lines) >= 5, filled(lines))
            .otherwise(F.array(text))
        )

    return let(trim(content), split)


def fold_runs(items: Column) -> Column:
    """Runs of three or more equal sections become one and a marker.

    struct(lines, folded): the folded array and the number of sections gone.
    """

    def build(keys: Column) -> Column:
        n = F.size(keys)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | ~F.get(keys, i).eqNullSafe(F.get(keys, i - 1)),
        )

        def with_starts(s: Column) -> Column:
            def length(at: Column, j: Column) -> Column:
                return F.coalesce(F.get(s, j + 1), n) - at

            runs = F.transform(
                s, lambda at, j: F.struct(at.alias("at"), length(at, j).alias("n"))
            )
            kept = F.transform(
                runs,
                lambda r: F.when(
                    r["n"] > 2, F.array(F.get(items, r["at"]), repeat_marker(r["n"]))
                ).otherwise(F.slice(items, r["at"] + 1, r["n"])),
            )
            gone = F.aggregate(
                runs, F.lit(0), lambda a, r: a + F.when(r["n"] > 2, r["n"] - 1).otherwise(0)
            )
            return F.struct(F.flatten(kept).alias("lines"), gone.alias("folded"))

        return let(starts, with_starts)

    same = F.struct(items.alias("lines"), F.lit(0).alias("folded"))
    keyed = let(F.transform(items, section_key), build)
    return F.when(F.size(items) <= 1, same).otherwise(keyed)


# For each level: lower-case literals, one of which any match contains; they are looked up first.
NEEDS = {
    12: ("error", "fail", "fatal", "exception", "panic", "crash", "critical", "cannot", "unable", "refused", "timeout", "rejected",
         "denied", "invalid", "trace"),
    8: ("warn", "alert", "caution", "attention", "notice", "deprecated", "obsolete", "outdated", "unstable"),
    4: ("important", "note", "key", "crucial", "essential", "significant", "todo", "fixme", "hack", "xxx", "review", "summary",
        "overview", "conclusion", "result"),
}


def _signal(text: Column) -> Column:
    """The points of the highest level whose words the text has."""

    def level(low: Column) -> Column:
        found = F.lit(0)
        for value, patterns in reversed(SIGNALS.items()):
            named = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in NEEDS[value]])
            found = F.when(named & text.rlike("|".join(ascii_words(p) for p in patterns)), value).otherwise(found)
        return found

    return let(F.lower(text), level)


def score(section: Column, index: Column, total: Column) -> Column:
    """How much a section deserves to stay."""

    def points(t: Column) -> Column:
        first = F.substring_index(t, "\n", 1)
        rows = F.split(section, "\n")
        second = trim(F.coalesce(F.get(rows, F.lit(1)), F.lit("")))
        length = F.length(t)
        position = (
            F.when(index == 0, 50)
            .when(index == total - 1, 30)
            .when(index <= F.ceil(total * F.lit(0.15)), 10)
            .when(index >= F.floor(total * F.lit(0.85)), 5)
            .otherwise(0)
        )
        heading = first.rlike(r"^#{1,6}\s")
        underlined = (F.length(trim(F.get(rows, F.lit(0)))) > 0) & second.rlike(r"^(?:={3,}|-{3,})\z")
        capitals = (
            F.length(first).between(3, 80)
            & first.rlike(r"^[A-Z0-9\s_\-/:]+\z")
            & (F.length(F.regexp_replace(first, r"\s", "")) >= 3)
        )
        def add(condition: Column, value: int) -> Column:
            return F.when(condition, value).otherwise(0)

        return (
            position
            + add(heading, 40)
            + add(underlined, 25)
            + add(capitals, 15)
            + _signal(t)
            + add(t.rlike(r"(?m)^[\s]*[-*+]\s|^[\s]*\d+[.)]\s"), 8)
            + add(F.contains(t, F.lit("`")) & t.rlike("`{1,3}[^`]+`{1,3}"), 5)
            + add((F.contains(t, F.lit("/")) | F.contains(t, F.lit("\\"))) & t.rlike(r"(?i)[/\\][\w.-]+\.[a-z]{2,6}(?![A-Za-z0-9_])"), 5)
            + add(F.contains(t, F.lit("://")) & t.rlike(r"(?<![A-Za-z0-9_])https?://\S+"), 5)
            + add(length.between(40, 800), 5)
            - add(length > 2000, 10)
            - add((length < 20) & ~heading, 5)
        )

    return let(trim(section), points)


def keep_best(parts: Column, max_tokens: int) -> Column:
    """Indexes to keep: first, last, and by score whatever still fits.

    Null when first and last alone exceed the budget. Sections that do not fit
    are skipped, later smaller ones may still be taken.
    """
    n = F.size(parts)
    ends = token_count(F.get(parts, F.lit(0))) + token_count(F.get(parts, n - 1)) + 2

    middle = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.struct(
            (-score(F.get(parts, i), i, n)).alias("order"),
            i.alias("index"),
            (token_count(F.get(parts, i)) + 1).alias("tokens"),
        ),
    )
    state = F.struct(ends.cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept"))
    chosen = F.aggregate(
        F.array_sort(middle),
        state,
        lambda s, m: F.when(
            s["used"] + m["tokens"] <= max_tokens,
            F.struct(
                (s["used"] + m["tokens"]).alias("used"),
                F.array_append(s["kept"], m["index"]).alias("kept"),
            ),
        ).otherwise(s),
        lambda s: s["kept"],
    )
    every = F.concat(F.array(F.lit(0)), F.array_sort(chosen), F.array(n - 1))
    return F.when(ends <= max_tokens, every)


def _truncated(content: Column, max_tokens: int) -> Column:
    total = token_count(content)
    return let(
        truncate_to_tokens(content, max_tokens),
        lambda cut: result(
            cut,
            line("Truncated to fit ", F.lit(max_tokens), " token budget (", total, " → ", token_count(cut), " tokens)"),
            line("Content truncated: ", total, " → ", token_count(cut), " tokens to fit budget of ", F.lit(max_tokens)),
        ),
    )


def compress(content: Column, max_tokens: int, goal: Column) -> Column:
    total = token_count(content)

    def small(parts: Column) -> Column:
        return let(
            fold_runs(parts),
            lambda f: let(
                F.array_join(f["lines"], "\n\n"),
                lambda text: F.when(
                    token_count(text) < total,
                    result(
                        text,
                        line("Folded consecutive repeats — ", total, " → ", token_count(text), " tokens"),
                        line("Folded ", f["folded"], " consecutive repeated sections"),
                    ),
                ).otherwise(result(content, "Content fits within token budget — no compression needed")),
            ),
        )

    def large(parts: Column) -> Column:
        n = F.size(parts)

        def render(kept: Column) -> Column:
            picked = F.transform(kept, lambda i: F.get(parts, i))
            folded = F.array_join(fold_runs(picked)["lines"], "\n\n")
            whole = F.array_join(picked, "\n\n")
            best = let(
                F.struct(folded.alias("f"), whole.alias("w")),
                lambda c: F.when(token_count(c["f"]) <= token_count(c["w"]), c["f"]).otherwise(c["w"]),
            )
            dropped = n - F.size(kept)

            def finish(text: Column) -> Column:
                percent = F.floor((F.lit(1.0) - token_count(text) / total) * 100 + 0.5)
                return result(
                    text,
                    line("Compressed ", n, " sections → ", F.size(kept), " kept, ", total, " → ",
                         token_count(text), " tokens (", percent, "% reduction)"),
                    F.when(
                        dropped > 0,
                        line("Dropped ", dropped, "/", n, " lower-relevance sections to fit ",
                             F.lit(max_tokens), " token budget (kept ", F.size(kept), ")"),
                    ),
                )

            return let(best, finish)

        chosen = let(
            keep_best(parts, max_tokens),
            lambda kept: F.when(kept.isNull(), _truncated(content, max_tokens)).otherwise(render(kept)),
        )
        return F.when(n <= 3, _truncated(content, max_tokens)).otherwise(chosen)

    def run(parts: Column) -> Column:
        return F.when(total <= max_tokens, small(parts)).otherwise(large(parts))

    return F.when(is_blank(content), result(content, "Empty content — nothing to compress")).otherwise(
        let(sections(content), run)
    )


def facts(content: Column) -> Column:
    """Every section with its score, as 'score:text'."""

    def rows(parts: Column) -> Column:
        return F.transform(
            parts,
            lambda p, i: F.struct(
                F.lit("section").alias("kind"),
                i.alias("ord"),
                F.concat(score(p, i, F.size(parts)).cast("string"), F.lit(":"), p).alias("value"),
            ),
        )

    return let(sections(content), rows)
