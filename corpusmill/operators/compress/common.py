"""What all compressors share: result shape, rendering, trim ladder.

A compressor is a Column function ``(content, max_tokens, goal) -> struct``
with compressed_content, summary and warnings. Everything about a document is
computed inside its own row, so compressing a corpus needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import is_blank, let, token_count, truncate_to_tokens

Strategy = Callable[[Column, int, Column], Column]
Facts = Callable[[Column], Column]

FACT = "array<struct<kind:string,ord:int,value:string>>"
STRINGS = "array<string>"


def none() -> Column:
    return F.array().cast(STRINGS)


def texts(*parts: Column | str) -> Column:
    """Array of the given lines."""
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def line(*parts: Column | str) -> Column:
    """One line from literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def when_lines(condition: Column, lines: Column) -> Column:
    return F.when(condition, lines).otherwise(none())


def lines_of(*groups: Column) -> Column:
    """Concatenate arrays of lines and join them to a text."""
    return F.array_join(F.concat(*groups), "\n")


def head(items: Column, n: Column | int) -> Column:
    return F.slice(items, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def tail(items: Column, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - n + 1), n)


def first_of(items: Column) -> Column:
    """First item or the empty string."""
    return F.coalesce(F.get(items, F.lit(0)), F.lit(""))


def last_of(items: Column) -> Column:
    return F.coalesce(F.get(items, F.size(items) - 1), F.lit(""))


def extract(lines: Column, pattern: str, group: int = 1) -> Column:
    """The group's non-empty matches, at most one per line, in order."""
    found = F.transform(lines, lambda x: F.regexp_extract(x, pattern, group))
    return F.filter(found, lambda x: F.length(x) > 0)


def or_else(text: Column, fallback: str) -> Column:
    return F.when(F.length(text) > 0, text).otherwise(F.lit(fallback))


def result(content: Column, summary: Column | str, *warnings: Column) -> Column:
    """The struct every compressor returns; null warnings are left out."""
    notes = F.array_compact(F.array(*warnings)) if warnings else none()
    return F.struct(
        content.alias("compressed_content"),
        (F.lit(summary) if isinstance(summary, str) else summary).alias("summary"),
        notes.cast(STRINGS).alias("warnings"),
    )


def budgeted(content: Column, max_tokens: int, what: str, compressed: Column) -> Column:
    """Blank or already small texts come back unchanged."""
    return (
        F.when(is_blank(content), result(content, f"Empty {what}"))
        .when(token_count(content) <= max_tokens, result(content, f"{what} fits within token budget"))
        .otherwise(compressed)
    )


def ladder(
    steps: Sequence[dict[str, int]], render: Callable[[Column], Column], max_tokens: int,
    least: Callable[[Column], Column] | None = None,
) -> Column:
    """Render with ever tighter limits; the first text that fits wins.

    ``steps`` are the limits of each rendering, looked up by name in the struct
    that ``render`` gets. Later ones are only rendered when needed; the last is
    cut to the budget. ``least``: characters that a rendering has at least; one
    that cannot fit is left out, unless it is the last.
    """
    names = list(steps[0])
    limits = F.array(
        *[F.struct(*[F.lit(step[n]).alias(n) for n in names], F.lit(k == len(steps) - 1).alias("_last"))
          for k, step in enumerate(steps)]
    )

    def tried(step: Column) -> Column:
        if least is None:
            return render(step)
        return F.when(step["_last"] | (least(step) <= 4 * max_tokens), render(step))

    chosen = F.aggregate(
        limits,
        F.lit(None).cast("string"),
        lambda found, step: F.when(
            found.isNotNull() & (token_count(found) <= max_tokens), found
        ).otherwise(tried(step)),
    )
    return let(
        chosen,
        lambda t: F.when(token_count(t) <= max_tokens, t).otherwise(
            truncate_to_tokens(t, max_tokens)
        ),
    )


# Head and tail shares kept by the truncation fallback.
SHARES = {"test_output": (0.5, 0.3), "command_output": (0.2, 0.3), "code": (0.4, 0.2)}


def shares_fallback(content: Column, max_tokens: int, content_type: str) -> Column:
    """Head and tail lines around a marker, cut to the budget."""
    first, last = SHARES[content_type]

    def cut(ls: Column) -> Column:
        n = F.size(ls)
        h = F.ceil(n * F.lit(first)).cast("int")
        t = F.ceil(n * F.lit(last)).cast("int")
        gone = F.greatest(F.lit(0), n - h - t)
        marker = texts(line("[... ", gone, " lines folded ...]"))
        kept = F.concat(head(ls, h), marker, F.slice(ls, F.greatest(F.lit(1), n - t + 1), t))
        return truncate_to_tokens(F.array_join(kept, "\n"), max_tokens)

    return let(F.split(content, "\n"), cut)


def facts_of(**kinds: Column) -> Column:
    """array<struct(kind, ord, value)> from arrays of strings by kind."""
    return F.concat(*[_numbered(kind, values) for kind, values in kinds.items()]).cast(FACT)


def _numbered(kind: str, values: Column) -> Column:
    return F.transform(
        values,
        lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), v.cast("string").alias("value")),
    )


def one(value: Column) -> Column:
    """A text as an array, empty when the text is."""
    return F.when(F.length(value) > 0, F.array(value)).otherwise(none())
