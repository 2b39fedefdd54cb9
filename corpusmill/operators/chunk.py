"""Chunking (J1-J5): documents to chunk rows, inside each document's own row.

Separators stay at the head of the section they open, so the chunks of a
document (apart from the repeated header of code) concatenate to its text and
``byte_offset`` is exact. A section list is packed greedily; the fold keeps
only byte counts and chunk starts, never the texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import char_start, let, trim

DEFAULT_MAX_TOKENS = 4000
BYTES_PER_TOKEN = 4

# Where texts may be cut, in order of preference.
TEXT_SEPARATORS = ("\n## ", "\n# ", "\n### ", "\n\n", "\n")
PLAIN_SEPARATORS = ("\n\n", "\n")
LOG_STARTS = (
    r"(?=\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})",
    r"(?=\[(?:ERROR|WARN|INFO|DEBUG|TRACE|FATAL)\])",
    r"(?=(?:ERROR|WARN|INFO|DEBUG|TRACE|FATAL)\s)",
)
CODE_SEPARATOR = "\nexport "


def before(separator: str) -> str:
    """Pattern that splits in front of a separator and keeps it."""
    escaped = separator.replace("\n", r"\n").replace("#", r"\#")
    return f"(?={escaped})"


def pack(sections: Column, max_bytes: Column | int) -> Column:
    """Join neighbouring sections into chunks of at most ``max_bytes``.

    A section that is larger by itself becomes a chunk of its own.
    """
    limit = max_bytes if isinstance(max_bytes, Column) else F.lit(max_bytes)

    def starts(sizes: Column) -> Column:
        state = F.struct(
            F.lit(0).alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts")
        )

        def step(s: Column, size: Column) -> Column:
            cut = (s["used"] > 0) & (s["used"] + size > limit)
            return F.struct(
                F.when(cut, size).otherwise(s["used"] + size).alias("used"),
                (s["at"] + 1).alias("at"),
                F.when(cut, F.array_append(s["cuts"], s["at"])).otherwise(s["cuts"]).alias("cuts"),
            )

        return F.aggregate(sizes, state, step, lambda s: s["cuts"])

    def build(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.octet_length(p))
        cuts = F.concat(F.array(F.lit(0)), starts(sizes), F.array(F.size(parts)))
        return let(
            cuts,
            lambda c: F.transform(
                F.sequence(F.lit(1), F.size(c) - 1),
                lambda i: F.array_join(
                    F.slice(
                        parts, F.element_at(c, i) + 1, F.element_at(c, i + 1) - F.element_at(c, i)
                    ),
                    "",
                ),
            ),
        )

    packed = let(sections, lambda p: F.filter(build(p), lambda chunk: F.length(chunk) > 0))
    return packed.cast("array<string>")


def byte_slices(content: Column, max_bytes: int) -> Column:
    """Slices of ``max_bytes`` bytes, each cut moved back to a whole character."""

    def cut(raw: Column) -> Column:
        count = F.ceil(F.octet_length(raw) / max_bytes).cast("int")

        def slice_(i: Column) -> Column:
            start = char_start(raw, (i * max_bytes).cast("int"))
            stop = char_start(raw, ((i + 1) * max_bytes).cast("int"))
            return F.decode(F.substring(raw, start + 1, stop - start), "UTF-8")

        return F.transform(F.sequence(F.lit(0), count - 1), slice_)

    return let(F.encode(content, "UTF-8"), cut).cast("array<string>")


def _first_that_fits(
    content: Column, patterns: Sequence[str], max_bytes: int, otherwise: Column
) -> Column:
    """Pack by the first pattern whose every section fits."""
    def attempt(pattern: str, rest: Column) -> Column:
        return let(
            F.split(content, pattern),
            lambda s: F.when(
                F.forall(s, lambda p: F.octet_length(p) <= max_bytes), pack(s, max_bytes)
            ).otherwise(rest),
        )

    result = otherwise
    for pattern in reversed(patterns):
        result = attempt(pattern, result)
    return result


def chunk_text(content: Column, max_tokens: int = DEFAULT_MAX_TOKENS) -> Column:
    """By headings, paragraphs, lines, else bytes."""
    size = max_tokens * BYTES_PER_TOKEN
    return _first_that_fits(
        content, [before(s) for s in TEXT_SEPARATORS], size, byte_slices(content, size)
    )


def chunk_plain(content: Column, max_tokens: int = DEFAULT_MAX_TOKENS) -> Column:
    """By paragraphs, lines, else bytes."""
    size = max_tokens * BYTES_PER_TOKEN
    return _first_that_fits(
        content, [before(s) for s in PLAIN_SEPARATORS], size, byte_slices(content, size)
    )


def chunk_log(content: Column, max_tokens: int = DEFAULT_MAX_TOKENS) -> Column:
    """By log entries, else as plain text."""
    size = max_tokens * BYTES_PER_TOKEN
    return _first_that_fits(content, LOG_STARTS, size, chunk_plain(content, max_tokens))


def _is_header(line: Column) -> Column:
    return (
        line.startswith("import ")
        | line.startswith("// @")
        | line.startswith("#!")
        | line.isin('"use strict";', "'use strict';")
        | (F.length(trim(line)) == 0)
    )


def chunk_code(content: Column, max_tokens: int = DEFAULT_MAX_TOKENS) -> Column:
    """The import header on every chunk, the body split at exports."""
    size = max_tokens * BYTES_PER_TOKEN

    def build(ls: Column) -> Column:
        flags = F.transform(ls, _is_header)
        first = F.array_position(flags, False)
        body_at = F.when(first == 0, F.size(ls)).otherwise(first - 1).cast("int")

        def with_header(header: Column) -> Column:
            body = F.array_join(F.slice(ls, body_at + 1, F.size(ls)), "\n")
            # the newline that joins header and body counts too
            room = F.lit(size) - F.octet_length(header) - F.when(F.length(header) > 0, 1).otherwise(0)
            packed = pack(F.split(body, before(CODE_SEPARATOR)), room)
            whole = F.transform(
                packed,
                lambda p: F.when(F.length(header) > 0, F.concat(header, F.lit("\n"), p)).otherwise(p),
            )
            cut = F.transform(
                whole,
                lambda c: F.when(F.octet_length(c) <= size, F.array(c)).otherwise(
                    chunk_plain(c, max_tokens)
                ),
            )
            return F.flatten(cut)

        return let(F.array_join(F.slice(ls, F.lit(1), body_at), "\n"), with_header)

    return let(F.split(content, "\n"), build)


# How each content type is chunked.
STRATEGY = {
    "code": chunk_code,
    "log": chunk_log,
    "test_output": chunk_log,
    "command_output": chunk_log,
    "markdown": chunk_text,
    "plain_text": chunk_text,
}


def chunk_texts(
    content: Column, content_type: Column, max_tokens: int = DEFAULT_MAX_TOKENS
) -> Column:
    """J5, dispatch: array of chunk texts."""
    small = F.octet_length(content) <= max_tokens * BYTES_PER_TOKEN
    by_type: dict = {}
    for kind, strategy in STRATEGY.items():
        by_type.setdefault(strategy, []).append(kind)
    chosen = F.when(small, F.array(content))
    for strategy, kinds in by_type.items():
        chosen = chosen.when(content_type.isin(*kinds), strategy(content, max_tokens))
    return chosen.otherwise(chunk_plain(content, max_tokens))


def chunk(
    docs: DataFrame, max_tokens: int = DEFAULT_MAX_TOKENS, content_type: str | Column = "content_type"
) -> DataFrame:
    """One row per chunk with chunk_index, total_chunks, byte_offset, byte_length.

    ``content`` becomes the chunk's text; the other columns are repeated.
    """
    kind = content_type if isinstance(content_type, Column) else F.col(content_type)
    texts = docs.withColumn("_chunks", chunk_texts(F.col("content"), kind, max_tokens))
    sizes = F.transform("_chunks", lambda c: F.octet_length(c))
    ends = F.aggregate(
        F.col("_sizes"),
        F.array(F.lit(0)),
        lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n),
    )
    located = texts.withColumn("_sizes", sizes).withColumn("_starts", ends)
    rows = F.transform(
        F.col("_chunks"),
        lambda c, i: F.struct(
            i.alias("chunk_index"),
            F.size("_chunks").alias("total_chunks"),
            F.get(F.col("_starts"), i).alias("byte_offset"),
            F.get(F.col("_sizes"), i).alias("byte_length"),
            c.alias("content"),
        ),
    )
    others = [c for c in docs.columns if c != "content"]
    return located.select(*others, F.explode(rows).alias("_row")).select(*others, "_row.*")
