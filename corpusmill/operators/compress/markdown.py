"""Markdown by prioritised sections and merged repeated ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import (
    WHITESPACE, ascii_words, let, normalize_title, token_count, trim, truncate_to_tokens,
)
from corpusmill.operators.compress.common import budgeted, facts_of, head, line, none, result
from corpusmill.operators.lines import HEADING

# Words and shapes that make a line worth keeping.
PRIORITY = ascii_words(r"(?i)\b(?:rollback|critical|warning|security|failure|readiness|required)\b")
TITLE_BONUS = ascii_words(r"(?i)\b(?:required|security|critical|failure|readiness|warning)\b")
PRIORITY_HINTS = ("rollback", "critical", "warning", "security", "failure", "readiness", "required")
# Each with lower-case literals (None: a digit), one of which any match contains; they are looked up first.
STRUCTURED = tuple((hints, ascii_words("(?i)" + "|".join(patterns))) for hints, patterns in [
    (("/",), [
        r"(?:^|\s)(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+\/\S+",
        r"\/(?:api|v\d+)(?:\/[A-Za-z0-9._~!$&'()*+,;=:@%-]+)+",
    ]),
    ((None,), [
        r"(?<![A-Za-z0-9_])\d+(?:\.\d+)?\s*(?:(?:ms|s|sec(?:onds?)?|m|min(?:utes?)?|h|hours?|kb|mb|gb|retries?"
        r"|requests?|tokens?|bytes?)(?![A-Za-z0-9_])|%(?=[A-Za-z0-9_]))",
        r"(?:<=|>=|<|>|=)\s*\d+(?:\.\d+)?",
    ]),
    (("npm", "yarn", "npx", "node", "git", "docker", "kubectl", "mvn", "gradle", "cargo", "python", "pip", "go"), [
        r"(?:^|\s)(?:npm|pnpm|yarn|npx|node|git|docker|kubectl|mvn|gradle|cargo|python|pip|go)\s+[^\n]+",
    ]),
    ((":", "="), [r"(?:^|\s)(?:[A-Z][A-Z0-9_]{2,}|[a-z][A-Za-z0-9]*(?:\.[A-Za-z0-9_-]+)+)\s*[:=]"]),
    (("`",), [r"`(?:[A-Z][A-Z0-9_]{2,}|[a-z][a-z0-9_]*(?:[._-][a-z0-9_]+)+)`"]),
])
LIST_ITEM = r"^(?:[-*+]\s+|\d+[.)]\s+)"
INTRO = "Document introduction"


def _named(low: Column, hints: tuple[str | None, ...]) -> Column:
    return reduce(lambda a, b: a | b, [low.rlike("[0-9]") if h is None else F.contains(low, F.lit(h)) for h in hints])


def _is_priority(text: Column, low: Column) -> Column:
    return _named(low, PRIORITY_HINTS) & text.rlike(PRIORITY)


def _is_structured(text: Column, low: Column) -> Column:
    return reduce(lambda a, b: a | b, [_named(low, hints) & text.rlike(pattern) for hints, pattern in STRUCTURED])


def parse_sections(ls: Column) -> Column:
    """(title, level, start, end, body) in order; headings inside fences are text."""
    def build(ls: Column) -> Column:
        n = F.size(ls)
        places = F.sequence(F.lit(0), n - 1)
        fences = F.filter(places, lambda i: trim(F.get(ls, i)).startswith("```"))

        def with_fences(marks: Column) -> Column:
            inside = lambda i: F.size(F.filter(marks, lambda m: m <= i)) % 2 == 1
            heads = F.filter(places, lambda i: F.get(ls, i).startswith("#") & F.get(ls, i).rlike(HEADING) & ~inside(i))
            return let(F.concat(F.array(F.lit(-1)), heads), cut)

        def cut(starts: Column) -> Column:
            def section(at: Column, j: Column) -> Column:
                after = F.coalesce(F.get(starts, j + 1), n)
                return F.struct(
                    F.when(at < 0, INTRO).otherwise(trim(F.regexp_extract(F.get(ls, at), HEADING, 2))).alias("title"),
                    F.when(at < 0, 1).otherwise(F.length(F.regexp_extract(F.get(ls, at), HEADING, 1))).alias("level"),
                    F.greatest(at, F.lit(0)).alias("start"), (after - 1).alias("end"),
                    F.slice(ls, at + 2, after - at - 1).alias("body"),
                )

            filled = lambda s: F.exists(s["body"], lambda b: F.length(trim(b)) > 0)
            return F.filter(F.transform(starts, section), lambda s: (s["title"] != INTRO) | filled(s))

        return F.when(ls.isNotNull(), let(fences, with_fences))

    return let(ls, build)


def _structured(body: Column) -> Column:
    kept = F.filter(
        F.transform(body, trim),
        lambda t: (F.length(t) > 0)
        & (t.rlike(LIST_ITEM) | let(F.lower(t), lambda low: _is_priority(t, low) | _is_structured(t, low))),
    )
    return head(F.array_distinct(kept), 8)


def goal_terms(goal: Column) -> Column:
    found = F.regexp_extract_all(
        F.lower(goal), F.lit("([a-z0-9_./-]{3,}|[\u4e00-\u9fff]{2,})"), 1
    )
    return F.coalesce(F.array_distinct(found), none())


def describe(sections: Column, goal: Column) -> Column:
    """Add key, priority, structured lines and score to every section."""

    def one(s: Column, terms: Column) -> Column:
        body = F.array_join(s["body"], "\n")
        both = F.concat(s["title"], F.lit("\n"), body)

        def scored(found: Column) -> Column:
            important = let(F.lower(both), lambda low: _is_priority(both, low))
            signals = F.aggregate(
                found, F.lit(0),
                lambda a, x: a + F.when(let(F.lower(x), lambda low: _is_structured(x, low)), 50).otherwise(15),
            )
            low = F.lower(both)
            named = F.size(F.filter(terms, lambda t: F.contains(low, t)))
            value = (
                F.when(important, 1000).otherwise(20)
                + F.when(s["title"].rlike(r"(?i)(?<![A-Za-z0-9_])rollback(?![A-Za-z0-9_])"), 250).otherwise(0)
                + F.least(signals, F.lit(240))
                + F.when(s["title"].rlike(TITLE_BONUS), 100).otherwise(0)
                + named * 120
            )
            return F.struct(
                (-value).alias("order"), s["start"].alias("start"), s["end"].alias("end"),
                normalize_title(s["title"]).alias("key"), important.alias("priority"),
                s["title"].alias("title"), s["level"].alias("level"), s["body"].alias("body"),
                found.alias("structured"),
            )

        return let(_structured(s["body"]), scored)

    return let(goal_terms(goal), lambda terms: F.transform(sections, lambda s: one(s, terms)))


def _card(s: Column) -> Column:
    filled = F.filter(s["body"], lambda x: F.length(trim(x)) > 0)
    lead = head(filled, F.when(s["priority"], 4).otherwise(2))
    chosen = head(
        F.array_distinct(F.concat(s["structured"], lead)), F.when(s["priority"], 8).otherwise(4)
    )
    heading = line(F.repeat(F.lit("#"), F.least(s["level"] + 1, F.lit(6))), " ", s["title"])
    return F.array_join(F.concat(F.array(heading), chosen), "\n")


def _cut(card: Column, budget: Column) -> Column:
    return F.when(token_count(card) <= budget, card).otherwise(truncate_to_tokens(card, budget))


def groups(sections: Column) -> Column:
    """Sections that share a normalised title, as one range each."""

    def build(keys: Column) -> Column:
        repeated = F.filter(
            F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda o: o == k)) > 1
        )

        def merge(k: Column, i: Column) -> Column:
            def card(same: Column) -> Column:
                best = F.get(F.array_sort(same), F.lit(0))
                signals = head(
                    F.array_distinct(F.flatten(F.transform(same, lambda s: s["structured"]))), 3
                )
                title = line(
                    "- **", best["title"], "** ×", F.size(same), " (source lines ",
                    F.get(same, F.lit(0))["start"] + 1, "–", F.get(same, F.size(same) - 1)["end"] + 1, ")",
                )
                rows = F.transform(signals, lambda x: F.concat(F.lit("  - "), x))
                return F.struct(
                    best["order"].alias("order"), i.alias("i"), F.size(same).alias("n"),
                    F.array_join(F.concat(F.array(title), rows), "\n").alias("card"),
                )

            return let(F.filter(sections, lambda s: s["key"] == k), card)

        return F.array_sort(F.transform(repeated, merge))

    return let(F.transform(sections, lambda s: s["key"]), build)


HEADER = "## Markdown Summary\n"


def render(sections: Column, repeated: Column, max_tokens: int) -> Column:
    """Cards in order of importance while they fit."""
    keys = F.transform(sections, lambda s: s["key"])
    single = let(keys, lambda k: F.filter(
        sections, lambda s: F.size(F.filter(k, lambda o: o == s["key"])) == 1))
    ordered = F.array_sort(single)
    important = F.filter(ordered, lambda s: s["priority"])
    unique = F.filter(ordered, lambda s: ~s["priority"])
    important_groups = F.filter(repeated, lambda g: g["order"] <= -1000)
    other_groups = F.filter(repeated, lambda g: g["order"] > -1000)
    pool = max(24, int(max_tokens * 0.48))
    count = F.size(important) + F.size(important_groups)
    share = F.greatest(F.lit(18), F.floor(F.lit(pool) / F.greatest(count, F.lit(1))))

    def entry(kind: int, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("card"))

    def titled(condition: Column, title: str, cards: Column) -> Column:
        some = F.concat(F.array(entry(0, F.lit(title))), cards)
        return F.when(condition, some).otherwise(
            F.array().cast("array<struct<kind:int,card:string>>")
        )

    cards = F.concat(
        titled(count > 0, "### Priority Sections", F.concat(
            F.transform(important, lambda s: entry(0, _cut(_card(s), share))),
            F.transform(important_groups, lambda g: entry(0, g["card"])))),
        titled(F.size(unique) > 0, "### Unique Sections", F.transform(unique, lambda s: entry(1, _card(s)))),
        titled(F.size(other_groups) > 0, "### Repeated Section Ranges",
               F.transform(other_groups, lambda g: entry(2, g["card"]))),
    )
    # kind 1 stops when under 18 tokens remain, kind 2 at the first that does not fit
    state = F.struct(F.lit(HEADER).alias("text"), F.lit(0).alias("stopped"))

    def step(s: Column, c: Column) -> Column:
        left = F.lit(max_tokens) - token_count(s["text"])
        card = F.when(c["kind"] == 1, _cut(c["card"], F.least(F.lit(90), left))).otherwise(c["card"])
        over = (c["kind"] == 1) & (left < 18)
        blocked = (s["stopped"] == c["kind"]) & (c["kind"] > 0)
        grown = F.concat(s["text"], F.lit("\n"), card, F.lit("\n"))
        fits = (token_count(grown) <= max_tokens) & (F.length(trim(card)) > 0)
        stop = F.when(over | ((c["kind"] == 2) & ~fits), c["kind"]).otherwise(s["stopped"])
        return F.when(
            blocked | over | ~fits, F.struct(s["text"].alias("text"), stop.alias("stopped"))
        ).otherwise(F.struct(grown.alias("text"), s["stopped"].alias("stopped")))

    return F.rtrim(F.aggregate(cards, state, step, lambda s: s["text"]), F.lit(WHITESPACE))


def compress(content: Column, max_tokens: int, goal: Column) -> Column:
    if max_tokens <= -(-len(HEADER) // 4) + 8:
        short = result(truncate_to_tokens(F.lit(HEADER), max_tokens), "Markdown compressed")
        return budgeted(content, max_tokens, "Markdown", short)

    def run(sections: Column) -> Column:
        def with_groups(repeated: Column) -> Column:
            def finish(text: Column) -> Column:
                merged = F.aggregate(repeated, F.lit(0), lambda a, g: a + g["n"])
                return result(
                    text,
                    line("Markdown compressed: ", F.size(sections), " sections, ", F.size(repeated), " repeated ranges"),
                    F.when(F.size(repeated) > 0, line(
                        "Merged ", merged, " repeated sections into ", F.size(repeated), " range summaries")),
                    F.when(token_count(text) >= max_tokens, F.lit("Trimmed markdown to fit token budget")),
                )

            return let(render(sections, repeated, max_tokens), finish)

        return let(groups(sections), with_groups)

    unix = F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")
    body = let(describe(parse_sections(unix), goal), run)
    return budgeted(content, max_tokens, "Markdown", body)


def facts(content: Column) -> Column:
    unix = F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")

    def rows(sections: Column) -> Column:
        return facts_of(
            section=F.transform(
                sections,
                lambda s: F.concat_ws("|", s["title"], s["key"], (-s["order"]).cast("string"),
                                      (s["start"] + 1).cast("string"), (s["end"] + 1).cast("string")),
            ),
            structured_line=F.flatten(F.transform(sections, lambda s: s["structured"])),
        )

    return let(describe(parse_sections(unix), F.lit(None).cast("string")), rows)
