"""Content metrics and follow-up decisions (N1-N7), one projection per document."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import ascii_words, is_blank, let, round_half_up, token_count, trim
from corpusmill.operators.route import guess_type
from corpusmill.sources.store import new_failures

Rules = list[tuple[Column, int, str | Column]]


@dataclass(frozen=True)
class Thresholds:
    """U4: the tunable limits of the decisions."""

    min_length: int = 2000
    min_tokens: int = 500
    error_density: float = 0.3
    repetition: float = 0.3
    recall: float = 0.3


DEFAULTS = Thresholds()

# What makes a line an error line. Words stand first in their pattern, which finds them fast; each
# pattern has groups of lower-case literals, of each of which any match contains one.
ERROR_WORDS = ("error", "exception", "fail", "crash", "panic", "fatal", "abort", "timeout")
ERROR_MARKS = ("[ERROR]", "[FATAL]", "[CRITICAL]", "[WARN]")
ERROR_LINE = [((w,), rf"(?i:{w})(?![A-Za-z0-9_])(?<![A-Za-z0-9_](?i:{w}))") for w in ERROR_WORDS] + [
    (needs, ascii_words(p)) for needs, p in [
        (("error", "syntax type reference range"), r"(?i:\b(?:syntax\s*error|type\s*error|reference\s*error|range\s*error)\b)"),
        (("0x",), r"\b(?:0x[0-9A-Fa-f]{8})\b"),
        (("assert", "fail error"), r"(?i:\bassert(?:ion)?\s*(?:failed|error)\b)"),
        (("traceback",), r"(?i:Traceback\s*\(most\s+recent\s+call\s+last\))"),
        (("caused",), r"(?i:Caused by:)"),
        (("exit",), r"(?i:Exit\s*code:\s*[1-9])"),
        (("at", "(", ":", ")"), r"^\s*at\s+\S+\s+\(.*:\d+:\d+\)"),
    ]
]

# Any error line has, in lower case, one of these (or an E with a digit, or all of a stack frame's); a cheap first test.
ERROR_HINTS = (
    "error", "exception", "fail", "crash", "panic", "fatal", "abort", "timeout", "0x", "[critical]", "[warn]",
    "traceback", "caused by:", "exit",
)
ERROR_NUMBER = r"E\d{4}"
FRAME_HINTS = ("at", "(", ":", ")")

# What a query says when earlier context would help.
RULE_PATTERNS = (
    r"(?i)\b(?:rule|guideline|convention|standard|policy|protocol|pattern|best\s*practice)\b",
    r"(?i)\b(?:code\s*style|lint|format|naming)\b",
    r"\b(?:CLAUDE\.md|AGENTS\.md|CONTRIBUTING|README)\b",
    r"(?i)\b(?:should|must|always|never)\s+\w+\s+(?:be|use|follow|do)\b",
    r"(?i)\b(?:project\s*(?:rule|convention|standard|guideline))\b",
)
BUG_PATTERNS = (
    r"(?i)\b(?:bug|issue|defect|regression|broken|fix|patch|workaround)\b",
    r"(?i)\b(?:previously|before|earlier|last\s*time|used\s*to)\b.+\b(?:bug|error|fail|break)\b",
    r"(?i)\b(?:recur|reappear|again|still)\b.+\b(?:error|fail|bug|issue)\b",
    r"(?i)\b(?:known\s*(?:issue|bug|problem|limitation))\b",
    r"(?i)\b(?:ticket|JIRA|github\s*issue)\b|(?<=[A-Za-z0-9_])#\d{2,}(?![A-Za-z0-9_])",
)
TASK_PATTERNS = (
    r"(?i)\b(?:current|ongoing|active|now|today|this\s*session)\s+(?:task|work|goal|focus|doing)\b",
    r"(?i)\b(?:what\s*(?:are|is|were)\s*(?:we|you|I)\s*(?:doing|working|building|implementing))\b",
    r"(?i)\b(?:continue|resume|pick\s*up|carry\s*on)\b",
    r"(?i)\b(?:task|todo|plan|milestone|sprint|iteration)\b",
    r"(?i)\b(?:where\s*(?:did|were)\s*(?:we|you|I)\s*(?:leave|stop|pause))\b",
)
ARCHITECTURE_PATTERNS = (
    r"(?i)\b(?:dependenc|package|library|module|import|require)\b",
    r"(?i)\b(?:architect|design|structure|layer|component|service|boundary)\b",
    r"\b(?:API|endpoint|route|contract|interface|schema|protocol)\b",
    r"(?i)\b(?:breaking\s*change|backward|compat|migration|upgrade|version)\b",
    r"(?i)\b(?:database|schema|migration|table|column|index|query)\b",
    r"(?i)\b(?:how\s*(?:does|is|do|are).*\b(?:connect|integrate|communicate|call|invoke|depend))\b",
)
# What text says that is worth remembering; each group needs any pattern.
DECIDED = (
    r"(?i)\b(?:decide|decision|agreed|concluded|resolved|chosen|opted)\b",
    r"(?i)\b(?:from now on|going forward|henceforth|hereafter)\b",
    r"(?i)\b(?:rule|policy|standard|guideline|convention)\b.+\b(?:set|establish|define|create|add)\b",
)
BUG_FOUND = (
    r"(?i)\b(?:bug|defect|regression|broken)\b.*\b(?:found|discovered|identified|reported|exists)\b",
    r"(?i)\b(?:root\s*cause|fix|workaround|patch)\b",
    r"(?i)\b(?:repro|reproduce|reproduction)\s*(?:steps|case|scenario)\b",
)
WORKING_ON = (
    r"(?i)\b(?:currently|now|today)\s+(?:working|building|implementing|fixing|debugging|adding)\b",
    r"(?i)\b(?:task|todo|goal|objective|milestone)\b.+(?:\b(?:is|are)\b|(?<=[A-Za-z0-9_]):(?=[A-Za-z0-9_]))",
)
PREFERS = (r"(?i)\b(?:prefer|preference|like|dislike|want|don't\s*want|always|never)\b",)
CONTRACT_CHANGE = (
    r"(?i)\b(?:API|endpoint|route|contract|schema|interface|dependency)\b.+\b(?:change|update|add|remove|deprecate|break)\b",
    r"(?i)\b(?:version|upgrade|migrate)\b.+\b(?:from|to)\b",
)
# What asks for an original.
NAMES_COMPRESSED = (
    r"(?i)\b(?:originalRef|original_ref|original-ref)\b",
    r"(?i)\b(?:ccr[-_]?\w+|compressed[-_]context)\b",
)
WANTS_EXPANSION = (r"(?i)\b(?:expand|retrieve|restore|recover|original|uncompressed|full)\b",)
MEANS_CONTENT = (r"(?i)\b(?:content|text|output|log|result)\b",)

HIGH_VALUE = ("test_output", "log", "command_output", "conversation_history", "rag_chunk")
CONSERVATIVE = ("code", "json", "markdown")


# For patterns run over whole texts: lower-case literals, one of which any match
# contains. They are looked up first, so most texts never reach the pattern.
NEEDS = {
    RULE_PATTERNS[0]: "rule guideline convention standard policy protocol pattern practice",
    RULE_PATTERNS[1]: "style lint format naming",
    RULE_PATTERNS[2]: "claude agents contributing readme",
    RULE_PATTERNS[3]: "should must always never",
    RULE_PATTERNS[4]: "project",
    BUG_PATTERNS[0]: "bug issue defect regression broken fix patch workaround",
    BUG_PATTERNS[1]: "previously before earlier last used",
    BUG_PATTERNS[2]: "recur reappear again still",
    BUG_PATTERNS[3]: "known",
    BUG_PATTERNS[4]: "ticket jira github #",
    TASK_PATTERNS[0]: "task work goal focus doing",
    TASK_PATTERNS[1]: "what",
    TASK_PATTERNS[2]: "continue resume pick carry",
    TASK_PATTERNS[3]: "task todo plan milestone sprint iteration",
    TASK_PATTERNS[4]: "where",
    ARCHITECTURE_PATTERNS[0]: "dependenc package library module import require",
    ARCHITECTURE_PATTERNS[1]: "architect design structure layer component service boundary",
    ARCHITECTURE_PATTERNS[2]: "api endpoint route contract interface schema protocol",
    ARCHITECTURE_PATTERNS[3]: "breaking backward compat migration upgrade version",
    ARCHITECTURE_PATTERNS[4]: "database schema migration table column index query",
    ARCHITECTURE_PATTERNS[5]: "how",
    DECIDED[0]: "decide decision agreed concluded resolved chosen opted",
    DECIDED[1]: "from|now|on going|forward henceforth hereafter",
    DECIDED[2]: "rule policy standard guideline convention",
    BUG_FOUND[0]: "bug defect regression broken",
    BUG_FOUND[1]: "cause fix workaround patch",
    BUG_FOUND[2]: "repro",
    WORKING_ON[0]: "currently now today",
    WORKING_ON[1]: "task todo goal objective milestone",
    PREFERS[0]: "prefer like want always never",
    CONTRACT_CHANGE[0]: "api endpoint route contract schema interface dependency",
    CONTRACT_CHANGE[1]: "version upgrade migrate",
    NAMES_COMPRESSED[0]: "original",
    NAMES_COMPRESSED[1]: "ccr compressed",
    WANTS_EXPANSION[0]: "expand retrieve restore recover original uncompressed full",
    MEANS_CONTENT[0]: "content text output log result",
}


def _any(text: Column, patterns: tuple[str, ...], lowered: Column | None = None) -> Column:
    found = F.lit(False)
    for p in patterns:
        hit = text.rlike(ascii_words(p))
        if lowered is not None:
            present = F.lit(False)
            for word in NEEDS[p].split():
                present = present | lowered.contains(word.replace("|", " "))
            hit = present & hit
        found = found | hit
    return found


def _may_be_error(text: Column) -> Column:
    """False only for texts without any error line."""

    def hinted(low: Column) -> Column:
        named = reduce(lambda a, b: a | b, [low.contains(h) for h in ERROR_HINTS])
        return named | reduce(lambda a, b: a & b, [low.contains(h) for h in FRAME_HINTS])

    return let(F.lower(text), hinted) | (F.contains(text, F.lit("E")) & text.rlike(ERROR_NUMBER))


def _is_error(line: Column) -> Column:
    """Any pattern of ERROR_LINE, an E with four digits or more, or a mark."""

    def named(low: Column) -> Column:
        found = reduce(lambda a, b: a | b, [F.contains(line, F.lit(m)) for m in ERROR_MARKS])
        found = found | (F.contains(line, F.lit("E")) & line.rlike(ascii_words(r"\b(?:E\d{4,})\b")))
        for needs, pattern in ERROR_LINE:
            present = [reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in group.split()]) for group in needs]
            found = found | (reduce(lambda a, b: a & b, present) & line.rlike(pattern))
        return found

    return let(F.lower(line), named)


def content_metrics(content: Column) -> Column:
    """struct(error_density, repetition_ratio, line_count)."""
    text = F.coalesce(content, F.lit(""))

    def measure(ls: Column) -> Column:
        filled = F.filter(F.transform(ls, trim), lambda x: x != "")
        matching = F.filter(ls, _is_error)
        errors = F.when(_may_be_error(text), F.size(matching)).otherwise(0)
        repeated = let(
            filled,
            lambda f: F.when(
                F.size(f) > 0, F.lit(1.0) - F.size(F.array_distinct(f)) / F.size(f)
            ).otherwise(0.0),
        )
        return F.struct(
            (errors / F.size(ls)).alias("error_density"),
            repeated.alias("repetition_ratio"),
            F.size(ls).alias("line_count"),
        )

    nothing = F.struct(
        F.lit(0.0).alias("error_density"),
        F.lit(0.0).alias("repetition_ratio"),
        F.lit(0).alias("line_count"),
    )
    return F.when(text == "", nothing).otherwise(let(F.split(text, "\n"), measure))


def _decision(score: Column, maximum: Column | int, threshold: float, *reasons: Column) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / maximum))
    return F.struct(
        (share >= threshold).alias("value"),
        round_half_up(share, 2).alias("confidence"),
        F.array_compact(F.array(*reasons)).alias("reasons"),
    )


def _judged(groups: dict[str, Column], threshold: float) -> Column:
    """The decision by how many groups hit; each group is tested once (inside a ``let`` Spark shares no work)."""

    def decide(hits: Column) -> Column:
        score = F.aggregate(hits, F.lit(0), lambda n, h: n + h.cast("int"))
        return _decision(score, len(groups), threshold, *[F.when(F.get(hits, F.lit(i)), name) for i, name in enumerate(groups)])

    return let(F.array(*groups.values()), decide)


def _step(value: Column, low: float, points: tuple[int, ...] = (3, 2, 1)) -> Column:
    return (
        F.when(value >= low * 4, points[0])
        .when(value >= low * 2, points[1])
        .when(value >= low, points[2])
        .otherwise(0)
    )


def should_compress(
    content: Column, content_type: Column, source: Column, metrics: Column,
    limits: Thresholds = DEFAULTS,
) -> Column:
    """N2."""
    length, tokens = F.length(content), token_count(content)
    kind = F.coalesce(content_type, F.lit("unknown"))
    by_length, by_tokens = _step(length, limits.min_length), _step(tokens, limits.min_tokens)
    by_type = (
        F.when(kind.isin(*HIGH_VALUE), 2)
        .when(kind == "unknown", 0)
        .otherwise(1)
    )
    density, repetition = metrics["error_density"], metrics["repetition_ratio"]
    risky = density >= limits.error_density
    by_repetition = (
        F.when(repetition >= limits.repetition, 2).when(repetition > 0.1, 1).otherwise(0)
    )
    helpful = F.lower(source).rlike("log|test|output|trace")
    score = (
        by_length + by_tokens + by_type + F.when(risky, -2).otherwise(0) + by_repetition
        + F.when(helpful, 1).otherwise(0)
    )
    return _decision(
        score, 13, 0.4,
        F.when(by_length > 0, "content_is_long").otherwise("content_is_short"),
        F.when(by_tokens > 0, "many_tokens").otherwise("few_tokens"),
        F.when(by_type == 2, "type_compresses_well").when(kind == "unknown", "type_is_unknown"),
        F.when(risky, "many_error_lines"),
        F.when(by_repetition > 0, "repetitive"),
        F.when(helpful, "source_compresses_well"),
    )


def should_recall(
    query: Column, content: Column, content_type: Column, limits: Thresholds = DEFAULTS
) -> Column:
    """N3."""
    q = F.coalesce(query, F.lit(""))
    groups = {
        "project_rules": RULE_PATTERNS,
        "historical_bugs": BUG_PATTERNS,
        "current_task": TASK_PATTERNS,
        "architecture": ARCHITECTURE_PATTERNS,
    }
    prior = (F.coalesce(F.length(content), F.lit(0)) > 0) & content_type.isin(
        "conversation_history", "file_summary"
    )
    prior = F.coalesce(prior, F.lit(False))

    def decide(hits: Column) -> Column:
        score = F.aggregate(hits, prior.cast("int"), lambda n, h: n + h.cast("int"))
        return _decision(
            score, F.when(prior, 5).otherwise(4), limits.recall,
            *[F.when(F.get(hits, F.lit(i)), name) for i, name in enumerate(groups)],
            F.when(prior, "prior_context"),
        )

    judged = let(F.lower(q), lambda low: let(F.array(*[_any(q, p, low) for p in groups.values()]), decide))
    nothing = F.struct(
        F.lit(False).alias("value"), F.lit(0.0).alias("confidence"),
        F.array(F.lit("no_query")).alias("reasons"),
    )
    return F.when(is_blank(q), nothing).otherwise(judged)


def should_save_memory(query: Column, content: Column) -> Column:
    """N4."""
    both = F.lower(F.concat(F.coalesce(query, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))))

    def judge(text: Column) -> Column:
        groups = {
            "decision_or_rule": _any(text, DECIDED, text),
            "bug_or_fix": _any(text, BUG_FOUND, text),
            "current_task": _any(text, WORKING_ON, text),
            "preference": _any(text, PREFERS, text) & (F.length(text) > 100),
            "contract_change": _any(text, CONTRACT_CHANGE, text),
        }
        return _judged(groups, 0.2)

    nothing = F.struct(
        F.lit(False).alias("value"), F.lit(0.0).alias("confidence"),
        F.array(F.lit("no_text")).alias("reasons"),
    )
    return let(both, lambda t: F.when(is_blank(t), nothing).otherwise(judge(t)))


def should_retrieve_original(query: Column, content: Column, content_type: Column) -> Column:
    """N5."""
    both = F.concat(F.coalesce(query, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")))
    size = F.coalesce(F.length(content), F.lit(0))

    def judge(text: Column, low: Column) -> Column:
        groups = {
            "names_compressed_row": _any(text, NAMES_COMPRESSED, low),
            "asks_for_original": _any(text, WANTS_EXPANSION, low) & _any(text, MEANS_CONTENT, low),
            "short_result": F.coalesce(
                content_type.isin("test_output", "log", "command_output"), F.lit(False)
            ) & (size > 0) & (size < 500),
        }
        return _judged(groups, 0.3)

    nothing = F.struct(
        F.lit(False).alias("value"), F.lit(0.0).alias("confidence"),
        F.array(F.lit("no_text")).alias("reasons"),
    )
    return let(
        both,
        lambda t: let(
            F.lower(t), lambda low: F.when(is_blank(t), nothing).otherwise(judge(t, low))
        ),
    )


ACTIONS = {
    "compress": "compress", "recall": "recall", "save_memory": "remember",
    "retrieve_original": "retrieve",
}


def analyze(docs: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Metrics, four decisions and suggested actions for every document.

    Needs ``content``; ``content_type``, ``query`` and ``source`` are optional
    columns. Stateless: runs on a stream too (S6).
    """
    def optional(name: str) -> Column:
        return F.col(name) if name in docs.columns else F.lit(None).cast("string")

    content, kind, query = F.coalesce("content", F.lit("")), optional("content_type"), optional("query")
    measured = docs.withColumn("metrics", content_metrics(content))
    metrics = F.col("metrics")
    decided = measured.withColumns(
        {
            "compress": should_compress(content, kind, optional("source"), metrics, limits),
            "recall": should_recall(query, content, kind, limits),
            "save_memory": should_save_memory(query, content),
            "retrieve_original": should_retrieve_original(query, content, kind),
            "stats": F.struct(
                F.length(content).alias("content_length"),
                token_count(content).alias("estimated_tokens"),
                F.coalesce(kind, guess_type(content)).alias("content_type"),
                round_half_up(metrics["error_density"], 3).alias("error_density"),
                round_half_up(metrics["repetition_ratio"], 3).alias("repetition_ratio"),
                metrics["line_count"].alias("line_count"),
            ),
        }
    )
    actions = [F.when(F.col(c)["value"], F.lit(a)) for c, a in ACTIONS.items()]
    return decided.withColumn("actions", F.array_compact(F.array(*actions))).drop("metrics")


HIGH_RETRIEVE_COUNT = 5


def high_retrieve_events(compressed: DataFrame, failures: DataFrame, now: Column | str) -> DataFrame:
    """A failure event for rows retrieved five times or more, once per row."""
    told = failures.filter(F.col("event_type") == "high_retrieve_count").select("scope_id", "ccr_id")
    often = compressed.filter(F.col("retrieve_count") >= HIGH_RETRIEVE_COUNT)
    rows = often.join(told, ["scope_id", "ccr_id"], "left_anti").withColumn(
        "error_reason",
        F.concat(F.lit("retrieved_"), F.col("retrieve_count"), F.lit("_times")),
    )
    return new_failures(rows, "retrieve_original", "high_retrieve_count", now, ["scope_id", "ccr_id"])
