"""Retrieved passages, deduplicated and ranked by score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import WORD_END as WE
from corpusmill.functions.text import ascii_words, let, round_half_up, token_count, trim
from corpusmill.functions.values import parse_json
from corpusmill.operators.compress.common import (
    budgeted, facts_of, head, ladder, line, lines_of, result, texts, when_lines,
)

# Field aliases and what counts as a factual sentence.
SOURCE, TITLE = ("source", "uri", "filePath", "path"), ("documentTitle", "title", "docTitle")
CHUNK_ID, SCORE = ("chunkId", "id", "chunk_id"), ("score", "relevance", "similarity")
BODY = ("content", "text", "excerpt")
FACT_WORDS = ascii_words(
    r"(?i)\b(?:is|are|must|should|always|never|requires|supports|accepts|returns|provides|uses"
    r"|version|endpoint|parameter|default|maximum|minimum|rate.limit)\b"
)
STARTS = rf"(?i)\n(?=\[?(?:source|chunk|document){WE})"
UNKNOWN = "(unknown)"


def _alias(v: Column, names: tuple[str, ...], kind: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])


def _chunk(source: Column, title: Column, chunk_id: Column, score: Column, content: Column) -> Column:
    return F.struct(
        source.alias("source"), title.alias("title"), chunk_id.alias("chunk_id"),
        score.alias("score"), content.alias("content"),
    )


def parse(content: Column) -> Column:
    """Passages of a JSON array or object, else of labelled text."""

    def from_json(v: Column) -> Column:
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
        return F.transform(
            items,
            lambda x, i: _chunk(
                F.coalesce(_alias(x, SOURCE, "string"), F.lit(UNKNOWN)),
                F.coalesce(_alias(x, TITLE, "string"), F.lit(UNKNOWN)),
                F.coalesce(_alias(x, CHUNK_ID, "string"), line("chk_", i)),
                F.coalesce(_alias(x, SCORE, "double"), F.lit(0.5)),
                F.coalesce(_alias(x, BODY, "string"), F.lit("")),
            ),
        )

    def labelled(s: Column, pattern: str, missing: Column) -> Column:
        found = trim(F.regexp_extract(s, pattern, 1))
        return F.when(F.length(found) > 0, found).otherwise(missing)

    from_text = F.transform(
        F.split(content, STARTS),
        lambda s, i: _chunk(
            labelled(s, r"(?i)(?:source|from)[: ]\s*(.+)", F.lit(UNKNOWN)),
            labelled(s, r"(?i)(?:title|document)[: ]\s*(.+)", F.lit(UNKNOWN)),
            labelled(s, r"(?i)(?:chunk[_-]?id|id)[: ]\s*(\S+)", line("chk_", i)),
            F.coalesce(
                F.regexp_extract(s, r"(?i)(?:score|relevance)[: ]\s*([\d.]+)", 1).try_cast("double"),
                F.lit(0.5),
            ),
            s,
        ),
    )
    opens = F.substring(trim(content), 1, 1).isin("[", "{")
    return let(
        F.when(opens, parse_json(content)),
        lambda v: F.when(v.isNotNull(), from_json(v)).otherwise(from_text),
    )


def extract_info(chunks: Column) -> Column:
    scores = F.transform(chunks, lambda c: c["score"])
    keys = F.transform(
        chunks, lambda c: F.sha2(F.concat(c["source"], F.lit("::"), trim(c["content"])), 256)
    )

    def rank(k: Column) -> Column:
        # of equal keys the highest score stays, at the place of the first one
        placed = F.transform(
            chunks,
            lambda c, i: F.struct(
                (-c["score"]).alias("order"), F.array_position(k, F.get(k, i)).alias("place"),
                i.alias("i"), c.alias("c"),
            ),
        )
        ordered = F.array_sort(placed)

        def first_per_place(o: Column) -> Column:
            places = F.transform(o, lambda p: p["place"])
            kept = let(places, lambda ps: F.filter(
                o, lambda _p, i: F.array_position(ps, F.get(ps, i)) == i + 1))
            return F.transform(kept, lambda p: p["c"])

        return let(ordered, first_per_place)

    def finish(unique: Column) -> Column:
        kept = unique
        total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
        return F.struct(
            kept.alias("chunks"),
            F.size(chunks).alias("total"),
            F.array_min(scores).alias("lowest"),
            F.array_max(scores).alias("highest"),
            round_half_up(total / F.greatest(F.size(scores), F.lit(1)), 2).alias("average"),
            (F.size(chunks) - F.size(unique)).alias("duplicates"),
            (F.size(unique) - F.size(kept)).alias("low_score"),
        )

    return let(let(keys, rank), finish)


def _number(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def key_facts(content: Column) -> Column:
    sentences = F.transform(head(F.split(content, r"[.;]\s*"), 5), trim)
    facts = F.filter(sentences, lambda s: F.length(s).between(20, 200) & s.rlike(FACT_WORDS))
    short = F.transform(
        facts,
        lambda s: F.when(F.length(s) > 120, F.concat(F.substring(s, 1, 117), F.lit("..."))).otherwise(s),
    )
    return head(short, 3)


MANY = 1_000_000
# Chunks (0: half, at least three), excerpt length and key facts
# of ever shorter renderings.
STEPS = (
    (MANY, MANY, 1), (MANY, 250, 1), (MANY, 100, 1), (MANY, 80, 0), (0, 120, 0), (3, 100, 0), (1, 80, 0),
    (1, MANY, 1),
)


# The labels of a card.
CARD_CHARS = 85


def _shown(i: Column, limits: Column) -> Column:
    """How many chunks a rendering may show."""
    half = F.greatest(F.lit(3), F.ceil(F.size(i["chunks"]) / 2).cast("int"))
    return F.when(limits["chunks"] == 0, half).otherwise(limits["chunks"])


def render(i: Column, limits: Column) -> Column:
    excerpt = limits["excerpt"]

    def card(c: Column, n: Column) -> Column:
        whole = c["content"]
        body = F.when(
            F.length(whole) > excerpt, F.concat(F.substring(whole, F.lit(1), excerpt), F.lit("..."))
        ).otherwise(whole)
        shown = F.when(
            F.length(body) > 300,
            F.concat(F.regexp_replace(F.substring(body, 1, 300), "\n", " "), F.lit("...")),
        ).otherwise(body)
        parts = [
            texts(line("### Chunk ", n + 1, ": `", c["chunk_id"], "`"), "",
                  line("- **Source:** `", c["source"], "`"), line("- **Document:** ", c["title"]),
                  line("- **Score:** ", F.format_string("%.2f", c["score"])), "- **canExpand:** true", "",
                  line("> ", shown)),
        ]
        facts = let(key_facts(body), lambda f: when_lines(F.size(f) > 0, F.concat(
            texts("", "**Key Facts:**"), F.transform(f, lambda x: F.concat(F.lit("- "), x)))))
        parts.append(when_lines(limits["facts"] == 1, facts))
        return F.concat(*parts, texts(""))

    chunks = head(i["chunks"], _shown(i, limits))
    return lines_of(
        texts("## RAG Chunks Summary", "", line("- **Total Chunks:** ", i["total"]),
              line("- **Kept:** ", F.size(chunks)),
              line("- **Score Range:** ", _number(i["lowest"]), " – ", _number(i["highest"]),
                   " (avg: ", _number(i["average"]), ")")),
        when_lines(i["duplicates"] > 0, texts(line("- **Duplicates Folded:** ", i["duplicates"]))),
        when_lines(i["low_score"] > 0, texts(line("- **Low-Score Folded:** ", i["low_score"]))),
        texts(""),
        F.flatten(F.transform(chunks, card)),
    )


def compress(content: Column, max_tokens: int, goal: Column) -> Column:
    def run(i: Column) -> Column:
        n = F.size(i["chunks"])
        steps = [dict(zip(("chunks", "excerpt", "facts"), v)) for v in STEPS]
        whole = F.exists(i["chunks"], lambda c: F.length(c["content"]) > 250)

        def finish(text: Column) -> Column:
            kept = F.regexp_count(text, F.lit(r"(?m)^### Chunk \d+: "))
            full = (kept == n) & ~(whole & (token_count(text) >= max_tokens))
            return result(
                text,
                line("RAG compressed: ", kept, "/", i["total"], " chunks kept"),
                F.when(i["duplicates"] > 0, line("Folded ", i["duplicates"], " duplicate chunks")),
                F.when(i["low_score"] > 0, line("Folded ", i["low_score"], " low-score chunks")),
                F.when(~full, F.lit("Trimmed RAG output to fit token budget")),
            )

        least = lambda limits: F.least(F.size(i["chunks"]), _shown(i, limits)) * CARD_CHARS
        return let(ladder(steps, lambda limits: render(i, limits), max_tokens, least), finish)

    body = let(parse(content), lambda c: let(extract_info(c), run))
    return budgeted(content, max_tokens, "RAG chunks", body)


def facts(content: Column) -> Column:
    def rows(i: Column) -> Column:
        return facts_of(
            chunk=F.transform(i["chunks"], lambda c: F.concat_ws(
                "|", c["source"], c["title"], c["chunk_id"], _number(c["score"]))),
            average_score=F.array(_number(i["average"])),
            duplicates=F.array(i["duplicates"].cast("string")),
            low_score=F.array(i["low_score"].cast("string")),
        )

    return let(parse(content), lambda c: let(extract_info(c), rows))
