"""Conversations by scored messages, steps, decisions and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import ascii_words, let, token_count, trim
from corpusmill.functions.values import kind_of, parse_json
from corpusmill.operators.compress.common import (
    budgeted, facts_of, head, ladder, line, lines_of, none, result, texts, when_lines,
)
from corpusmill.operators.ranking import rank_in_buckets

# What makes a message worth keeping.
GOAL = ascii_words(
    r"(?i)\b(?:goal|objective|task|need to|want to|fix|implement|build|create|add|remove|change|update)\b"
)
DECISION = ascii_words(
    r"(?i)\b(?:decided|decision|decisions|agreed|chose|opted|settled on|going to go with|we will|we should|let'?s go with)\b"
)
ERROR = ascii_words(r"\b(?:error|Error|ERROR|fail|FAIL|exception|Exception|crash|bug|Bug|broken)\b")
STRONG_ERROR = ascii_words(r"\b(?:error|Error|ERROR|exception|Exception|Traceback|FAIL|FAILED)\b")
PLEASANTRY = ascii_words(
    r"(?i)\b(?:hi|hello|hey|thanks|thank you|you'?re welcome|great|awesome|cool|okay|sure|got it|no problem|np)\b"
)
FILE_PATH = ascii_words(
    r"\b(?:(?:src|lib|tests?|docs?|app|components?|utils?|services?|configs?)\/[\w./-]+\.[\w]{1,6})\b"
)
DONE = r"(?m)^\s*(?:-\s*\[x\]|✓|✅|✔️|done:)\s*(.+)"
TODO = r"(?m)^\s*(?:-\s*\[\s\]|⬜|⭕|todo:)\s*(.+)"
ROLE = r"(?i)<(user|assistant|system|tool)>"


def message_score(content: Column, role: Column, index: Column, total: Column) -> Column:
    t = trim(content)

    def add(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    recency = F.least(F.lit(15), F.floor(index / F.greatest(total, F.lit(1)) * 15))
    checklist = content.rlike("(?i)" + DONE) | content.rlike("(?i)" + TODO)
    value = (
        F.lit(10)
        + add(role == "system", 30)
        + add((role == "user") & (index == 0), 40)
        + add(content.rlike(GOAL), 30)
        + add(content.rlike(DECISION), 25)
        + add(content.rlike(ERROR), 20)
        + add(content.rlike(FILE_PATH), 15)
        + add(content.contains("```"), 15)
        + add(checklist, 20)
        - add(t.rlike(PLEASANTRY) & (F.length(t) < 100), 15)
        - add((F.length(t) < 20) & ~t.rlike("(?i)error|fail|goal|decision"), 20)
        - add(F.length(t) > 1000, 10)
        + recency
    )
    return F.greatest(F.lit(0), value).cast("int")


def keep_count(total: Column) -> Column:
    return F.greatest(F.least(F.lit(15), total), F.ceil(total * F.lit(0.4)))


TURNS_PER_BUCKET = 1024


def top_messages(messages: DataFrame) -> DataFrame:
    """the best messages of every conversation table row (conv_id, turn, role, content).

    A conversation may hold a large share of all turns, so its messages are
    ranked in (score, turn range) buckets and never sorted as one group.
    """
    ordered = rank_in_buckets(
        messages,
        ["conv_id"],
        {"_range": F.floor(F.col("turn") / TURNS_PER_BUCKET)},
        [F.col("turn")],
        rank="_position",
        total="messages",
    )
    scored = ordered.withColumn(
        "score",
        message_score(F.col("content"), F.col("role"), F.col("_position") - 1, F.col("messages")),
    ).drop("_position")
    ranked = rank_in_buckets(
        scored,
        ["conv_id"],
        {"_score": -F.col("score"), "_range": F.floor(F.col("turn") / TURNS_PER_BUCKET)},
        [F.col("turn")],
    )
    return ranked.filter(F.col("rank") <= keep_count(F.col("messages")))


MESSAGE = "array<struct<role:string,content:string>>"


def _message(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def _from_text(text: Column) -> Column:
    state = F.struct(
        F.lit("unknown").alias("role"), none().alias("body"), F.array().cast(MESSAGE).alias("done")
    )

    def flush(s: Column) -> Column:
        entry = _message(s["role"], trim(F.array_join(s["body"], "\n")))
        return F.when(F.size(s["body"]) > 0, F.array_append(s["done"], entry)).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        role = F.lower(F.regexp_extract(x, ROLE, 1))
        rest = trim(F.regexp_replace(x, "(?s)^(.*?)<(?i:user|assistant|system|tool)>", "$1"))
        opened = F.struct(
            role.alias("role"),
            F.when(F.length(rest) > 0, F.array(rest)).otherwise(none()).alias("body"),
            flush(s).alias("done"),
        )
        goes_on = F.struct(
            s["role"].alias("role"), F.array_append(s["body"], x).alias("body"), s["done"].alias("done")
        )
        return F.when(F.length(role) > 0, opened).otherwise(goes_on)

    return F.aggregate(F.split(text, "\n"), state, step, flush)


def _from_json(v: Column) -> Column:
    items = F.try_variant_get(v, "$.messages", "array<variant>")
    base = F.transform(
        items,
        lambda m: _message(
            F.coalesce(F.try_variant_get(m, "$.role", "string"), F.lit("unknown")),
            F.coalesce(F.try_variant_get(m, "$.content", "string"),
                       F.to_json(F.try_variant_get(m, "$.content", "variant")), F.lit("")),
        ),
    )

    def extra(label: str, field: str) -> Column:
        value = F.try_variant_get(v, f"$.{field}", "variant")
        text = F.when(kind_of(value) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))
        text = F.coalesce(text, F.to_json(value))
        return F.when(value.isNotNull(), F.array(_message("system", line(label, ": ", text)))).otherwise(
            F.array().cast(MESSAGE)
        )

    return F.when(
        items.isNotNull(),
        F.concat(extra("Goal", "goal"), base, extra("Completed", "completedSteps"),
                 extra("Pending", "pendingSteps"), extra("Decisions", "keyDecisions")).cast(MESSAGE),
    )


def parse(content: Column) -> Column:
    def read(t: Column) -> Column:
        found = F.when(t.startswith("{"), let(parse_json(t), lambda v: F.when(v.isNotNull(), _from_json(v))))
        return F.coalesce(found, _from_text(t))

    messages = let(trim(content), read)
    return let(messages, lambda ms: F.transform(
        ms, lambda m, i: F.struct(
            i.alias("index"), m["role"].alias("role"), m["content"].alias("content"),
            message_score(m["content"], m["role"], i, F.size(ms)).alias("score"))))


def _listed(messages: Column, label: str) -> Column:
    """Items of a 'Label: [...]' system message."""
    marked = F.filter(messages, lambda m: (m["role"] == "system") & m["content"].startswith(label + ":"))
    text = F.regexp_replace(F.get(marked, F.lit(0))["content"], f"^{label}:\\s*", "")
    return F.coalesce(F.from_json(text, "array<string>"), none())


def _all_matches(messages: Column, pattern: str) -> Column:
    found = F.transform(messages, lambda m: F.regexp_extract_all(m["content"], F.lit(pattern), 1))
    return F.transform(F.flatten(found), trim)


def extract_info(ms: Column) -> Column:
    """Every fact in full; what a budget leaves out is decided by ``render``."""
    goals = F.filter(ms, lambda m: (m["role"] == "system") & m["content"].startswith("Goal:"))
    users = F.filter(ms, lambda m: m["role"] == "user")
    goal = F.coalesce(
        F.regexp_replace(F.get(goals, F.lit(0))["content"], r"^Goal:\s*", ""),
        F.get(users, F.lit(0))["content"],
        F.lit("(not detected)"),
    )
    sentences = F.flatten(F.transform(
        F.filter(ms, lambda m: m["content"].rlike(DECISION)),
        lambda m: F.filter(
            F.split(m["content"], r"[.;]\s+|\n"),
            lambda s: s.rlike(DECISION) & (F.length(s) > 20))))
    failing = F.array_sort(F.transform(
        F.filter(ms, lambda m: m["content"].rlike(ERROR)),
        lambda m: F.struct(
            F.when(m["content"].rlike(STRONG_ERROR), 0).otherwise(1).alias("weak"),
            (-m["score"]).alias("order"), m["index"].alias("index"), trim(m["content"]).alias("text"))))
    errors = F.transform(failing, lambda e: e["text"])
    files = F.array_distinct(F.flatten(F.transform(
        ms, lambda m: F.regexp_extract_all(m["content"], F.lit(f"({FILE_PATH})"), 1))))
    best = F.transform(
        F.array_sort(F.transform(ms, lambda m: F.struct((-m["score"]).alias("o"), m["index"].alias("i")))),
        lambda x: x["i"])
    kept_ids = F.array_sort(head(best, keep_count(F.size(ms)).cast("int")))
    return F.struct(
        goal.alias("goal"),
        F.concat(_listed(ms, "Completed"), _all_matches(ms, DONE)).alias("done"),
        F.concat(_listed(ms, "Pending"), _all_matches(ms, TODO)).alias("todo"),
        F.concat(_listed(ms, "Decisions"), F.transform(sentences, trim)).alias("decisions"),
        errors.alias("errors"),
        files.alias("files"),
        F.transform(kept_ids, lambda i: F.get(ms, i)).alias("messages"),
        F.size(ms).alias("total"),
    )


# Messages, decisions and errors of ever shorter renderings.
STEPS = ((15, 8, 3), (10, 5, 3), (5, 3, 1), (3, 2, 1))


def render(i: Column, limits: Column) -> Column:
    def section(title: str, items: Column, show) -> Column:
        return when_lines(F.size(items) > 0, F.concat(texts(title), F.transform(items, show), texts("")))

    def show_message(m: Column) -> Column:
        face = F.when(m["role"] == "assistant", "🤖").when(m["role"] == "user", "👤").otherwise("📋")
        excerpt = F.when(
            F.length(m["content"]) > 300,
            F.concat(F.regexp_replace(F.substring(m["content"], 1, 300), "\n", " "), F.lit("...")),
        ).otherwise(m["content"])
        return line("**", face, " ", m["role"], "** (score: ", m["score"], "): ", excerpt, "\n")

    shown = head(i["messages"], limits["messages"])
    found = F.transform(
        head(i["errors"], limits["errors"]),
        lambda e: F.when(F.length(e) > 200, F.concat(F.substring(e, 1, 197), F.lit("..."))).otherwise(e))
    short = F.filter(i["decisions"], lambda d: F.length(d) < 300)
    folded = i["total"] - F.size(i["messages"])
    return lines_of(
        texts("## Conversation Summary", "", "### Current Goal", line("> ", F.substring(i["goal"], 1, 200)), ""),
        section("### Completed Steps", head(i["done"], 10), lambda s: F.concat(F.lit("- [x] "), s)),
        section("### Pending Steps", head(i["todo"], 10), lambda s: F.concat(F.lit("- [ ] "), s)),
        section("### Key Decisions", head(short, limits["decisions"]), lambda s: F.concat(F.lit("- "), s)),
        when_lines(F.size(found) > 0, F.concat(texts("### Recent Errors", "```"), found, texts("```", ""))),
        section("### Relevant Files", head(i["files"], 10), lambda s: F.concat(F.lit("- `"), s, F.lit("`"))),
        when_lines(F.size(shown) > 0, F.concat(texts("### Key Messages", ""), F.transform(shown, show_message))),
        when_lines(folded > 0, texts(line("- **Messages Folded:** ", folded, "/", i["total"]))),
    )


def compress(content: Column, max_tokens: int, goal: Column) -> Column:
    def run(i: Column) -> Column:
        steps = [dict(zip(("messages", "decisions", "errors"), v)) for v in STEPS]
        text = ladder(steps, lambda limits: render(i, limits), max_tokens)
        return let(text, lambda t: result(
            t,
            line("Conversation compressed: ", F.size(i["messages"]), "/", i["total"], " messages kept"),
            F.when(token_count(t) >= max_tokens, F.lit("Trimmed conversation output to fit token budget")),
        ))

    body = let(parse(content), lambda ms: let(extract_info(ms), run))
    return budgeted(content, max_tokens, "Conversation", body)


def facts(content: Column) -> Column:
    def rows(i: Column) -> Column:
        return facts_of(
            goal=F.array(i["goal"]), completed=i["done"], pending=i["todo"], decision=i["decisions"],
            error=i["errors"], file=i["files"],
            message=F.transform(i["messages"], lambda m: F.concat_ws(
                "|", m["index"].cast("string"), m["role"], m["score"].cast("string"))),
        )

    return let(parse(content), lambda ms: let(extract_info(ms), rows))
