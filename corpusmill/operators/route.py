"""Content routing: which kind of text is each document.

One projection tests every signal of every type. A signal is a regular
expression plus literals at least one of which any match must contain; the
literals are looked up on the UTF-8 bytes first, so that most documents never
reach the regular expression.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import WORD_END as WE
from corpusmill.functions.text import WORD_START as WS
from corpusmill.functions.text import is_blank, let, round_half_up, trim
from corpusmill.functions.values import is_json
from corpusmill.schemas import CONTENT_TYPES

MIN_CONFIDENCE = 0.2
DETECTION = "struct<content_type:string,confidence:double,signals:array<string>>"

# Tie-break order of equally confident types.
TYPE_PRIORITY = (
    "test_output", "log", "command_output", "code", "json", "markdown",
    "rag_chunk", "conversation_history", "file_summary", "plain_text", "unknown",
)


@dataclass(frozen=True)
class Signal:
    """A named pattern; ``needs`` are lower-case literals, one of which must occur.

    With ``exact`` they stand in the text as they are written, in their case.
    """

    name: str
    pattern: str
    needs: tuple[str, ...] = ()
    exact: bool = False

    def found(self, content: Column, lowered: Column) -> Column:
        match = content.rlike(self.pattern)
        if not self.needs:
            return match
        where = content if self.exact else lowered
        present = reduce(lambda a, b: a | b, [where.contains(n) for n in self.needs])
        return present & match


@dataclass(frozen=True)
class Detector:
    """A type with its signals and the number of them that must match."""

    content_type: str
    signals: tuple[Signal, ...]
    min_matches: int = 2


def _s(name: str, pattern: str, *needs: str) -> Signal:
    return Signal(name, pattern, needs, exact=not pattern.startswith("(?i"))


# The signal names and patterns of every detector.
TEST_OUTPUT = Detector("test_output", (
    _s("AssertionError", r"(?i)assertionerror|assertion error", "assertion"),
    _s("Expected", rf"(?i){WS}expected[:\s]", "expected"),
    _s("Received", rf"(?i){WS}received[:\s]", "received"),
    _s("FAIL", rf"{WS}FAIL(?:ED)?{WE}", "FAIL"),
    _s("test failed", r"(?im)tests?.*failed|failed.*tests?|^\d+\s+failed", "failed"),
    _s("Test Suites", r"(?i)test\s*suites?:", "suite"),
    _s("jest", rf"(?i){WS}jest{WE}", "jest"),
    _s("vitest", rf"(?i){WS}vitest{WE}", "vitest"),
    _s("pytest", rf"(?i){WS}pytest{WE}", "pytest"),
    _s("mocha", rf"(?i){WS}mocha{WE}", "mocha"),
    _s("unittest", rf"(?i){WS}unittest{WE}", "unittest"),
))
LOG = Detector("log", (
    _s("ERROR", rf"{WS}ERROR{WE}", "ERROR"),
    _s("WARN", rf"{WS}WARN(?:ING)?{WE}", "WARN"),
    _s("INFO", rf"{WS}INFO{WE}", "INFO"),
    _s("Exception", rf"(?i){WS}exception{WE}", "exception"),
    _s("Traceback", rf"(?i){WS}traceback{WE}", "traceback"),
    _s("stack trace", r"(?i)stack\s*trace", "stack"),
    _s("timestamp", rf"{WS}\d{{4}}[-/]\d{{2}}[-/]\d{{2}}(?:[T ]\d{{2}}:\d{{2}})?", "-", "/"),
    _s("request id", r"(?i)request[_\-\s]?id", "request"),
    _s("DEBUG", rf"{WS}DEBUG{WE}", "DEBUG"),
    _s("error class", rf"{WS}[A-Z]\w*(?:Error|Exception){WE}", "Error", "Exception"),
    _s("traceback file", r'(?i)File\s+".+",\s+line\s+\d+', "file"),
))
COMMAND_OUTPUT = Detector("command_output", (
    _s("stdout", rf"(?i){WS}stdout{WE}", "stdout"),
    _s("stderr", rf"(?i){WS}stderr{WE}", "stderr"),
    _s("exit code", r"(?i)exit\s*(?:code|status)[:\s]*\d+", "exit"),
    _s("command", rf"(?i){WS}command{WE}", "command"),
    _s("command prompt", r"(?m)^[$#>]\s", "$", "#", ">"),
    _s("build failed", r"(?i)build\s*(?:failed|failure)", "build"),
    _s("shell output", r"(?i)shell\s*output", "shell"),
    _s("path prompt", r"(?m)^[A-Z]:[\\/].*?>", ">"),
    _s("error level", r"(?i)error\s*level", "error"),
))
CODE = Detector("code", (
    _s("import", rf"{WS}import{WE}", "import"),
    _s("export", rf"{WS}export{WE}", "export"),
    _s("function", rf"{WS}function{WE}", "function"),
    _s("class", rf"{WS}class\s+\w+", "class"),
    _s("interface", rf"{WS}interface\s+\w+", "interface"),
    _s("type", rf"{WS}(?:import\s+)?type{WE}", "type"),
    _s("const", rf"{WS}const\s+\w+", "const"),
    _s("let", rf"{WS}let\s+\w+", "let"),
    _s("def", rf"{WS}def\s+\w+", "def"),
    _s("public", rf"{WS}public{WE}", "public"),
    _s("private", rf"{WS}private{WE}", "private"),
    _s("return", rf"{WS}return{WE}", "return"),
    _s("async", rf"{WS}async{WE}", "async"),
    _s("arrow function", r"=>\s*[{(\[]", "=>"),
    _s("enum", rf"{WS}enum\s+\w+", "enum"),
    _s("extends", rf"{WS}extends{WE}", "extends"),
    _s("implements", rf"{WS}implements{WE}", "implements"),
), min_matches=3)
MARKDOWN = Detector("markdown", (
    _s("heading", r"(?m)^#{1,6}\s+\S", "#"),
    _s("unordered list", r"(?m)^\s*[-*+]\s+\S", "-", "*", "+"),
    _s("ordered list", r"(?m)^\s*\d+[.)]\s+\S", ".", ")"),
    _s("code block", r"```", "```"),
    _s("bold", r"\*\*[^*]+\*\*", "**"),
    _s("italic", r"(?<!\*)\*(?!\*)[^*]+\*(?!\*)", "*"),
    _s("link", r"\[.+?\]\(.+?\)", "]("),
    _s("table", r"(?m)^\|.+\|.*\n\|[-| :]+\|", "|"),
    _s("blockquote", r"(?m)^>\s", ">"),
))
RAG_CHUNK = Detector("rag_chunk", (
    _s("source", rf"(?i){WS}source(?:_|{WE})", "source"),
    _s("chunk", rf"(?i){WS}chunk(?:_|{WE})", "chunk"),
    _s("document", rf"(?i){WS}document(?:_|{WE})", "document"),
    _s("metadata", rf"(?i){WS}metadata(?:_|{WE})", "metadata"),
    _s("score", rf"(?i){WS}score(?:_|{WE})", "score"),
    _s("chunk_id", rf"(?i){WS}chunk[_\s]?id{WE}", "chunk"),
    _s("document_id", rf"(?i){WS}document[_\s]?id{WE}", "document"),
    _s("excerpt", rf"(?i){WS}excerpt{WE}", "excerpt"),
    _s("relevance", rf"(?i){WS}relevance{WE}", "relevance"),
))
CONVERSATION = Detector("conversation_history", (
    _s("role field", r'"role"\s*:', '"role"'),
    _s("content field", r'"content"\s*:', '"content"'),
    _s("user:", r"(?im)^user\s*:", "user"),
    _s("assistant:", r"(?im)^(?:assistant|ai|bot)\s*:", ":"),
    _s("system:", r"(?im)^system\s*:", "system"),
    _s("human:", r"(?im)^human\s*:", "human"),
    _s("messages array", r'"messages"\s*:', '"messages"'),
    _s("conversation", rf"(?i){WS}conversation{WE}", "conversation"),
    _s("turn marker", r"(?im)^={3,}\s*(?:turn|step|message|round)", "==="),
))

DETECTORS: dict[str, Detector] = {
    d.content_type: d
    for d in (TEST_OUTPUT, LOG, COMMAND_OUTPUT, CODE, MARKDOWN, RAG_CHUNK, CONVERSATION)
}


def register_detector(
    content_type: str, signals: dict[str, str] | Iterable[Signal], min_matches: int = 2
) -> None:
    """Add or replace the detector of a content type."""
    if content_type not in CONTENT_TYPES:
        raise ValueError(f"unknown content type: {content_type}")
    if isinstance(signals, dict):
        signals = [Signal(name, pattern) for name, pattern in signals.items()]
    DETECTORS[content_type] = Detector(content_type, tuple(signals), min_matches)


def matched_signals(content: Column, detector: Detector) -> Column:
    """Names of the signals that match; the text is worked out once, however it is made and wherever a filter goes."""

    def names(text: Column, lowered: Column) -> Column:
        return F.array_compact(
            F.array(*[F.when(s.found(text, lowered), F.lit(s.name)) for s in detector.signals])
        )

    return let(content, lambda text: let(F.lower(text), lambda lowered: names(text, lowered)))


def confidence(matched: Column, total: int, min_matches: int, boost: float = 0.0) -> Column:
    """Linear from 0.25 at the minimum to 0.95 at all signals."""
    if total > min_matches:
        linear = F.lit(0.25) + F.lit(0.7) * ((matched - min_matches) / (total - min_matches))
    else:
        linear = F.lit(0.25)
    base = F.when(matched >= total, F.lit(0.95)).otherwise(linear)
    found = F.least(F.lit(0.95), round_half_up(base + F.lit(boost), 2))
    return F.when(matched < min_matches, F.lit(min(0.15, boost))).otherwise(found)


def _detection(detector: Detector, signals: Column) -> Column:
    matched = F.size(signals)
    result = F.struct(
        F.lit(detector.content_type).alias("content_type"),
        confidence(matched, len(detector.signals), detector.min_matches).alias("confidence"),
        signals.alias("signals"),
    )
    return F.when(matched >= detector.min_matches, result)


def _json_signals(content: Column) -> Column:
    """I5, first half: signals, null when the text does not open like JSON."""
    t = trim(content)
    opens = F.substring(t, 1, 1)
    parse = (
        F.when(is_json(content), F.lit("JSON.parse success"))
        .when(t.rlike(r'"\w+":'), F.lit("key-value pairs"))
    )
    found = F.array_compact(F.array(F.concat(F.lit("starts with "), opens), parse))
    return F.when(opens.isin("{", "["), found)


def _json_detection(content: Column, signals: Column) -> Column:
    """I5, second half."""
    parsed = F.array_contains(signals, "JSON.parse success")
    value = (
        F.when(parsed & (F.length(trim(content)) > 20), 0.95)
        .when(parsed, 0.85)
        .otherwise(0.4)
    )
    result = F.struct(
        F.lit("json").alias("content_type"), value.alias("confidence"), signals.alias("signals")
    )
    return F.when(signals.isNotNull() & (F.size(signals) >= 2), result)


def detect(
    docs: DataFrame,
    content_type: str,
    content: str = "content",
    output: str = "detection",
) -> DataFrame:
    """Add one detector's result, null where it does not fire."""
    c = F.col(content)
    if content_type == "json" and "json" not in DETECTORS:
        staged = docs.withColumn("_signals", _json_signals(c))
        result = _json_detection(c, F.col("_signals"))
    else:
        detector = DETECTORS[content_type]
        staged = docs.withColumn("_signals", matched_signals(c, detector))
        result = _detection(detector, F.col("_signals"))
    return staged.withColumn(output, result).drop("_signals")


def route(docs: DataFrame, content: str = "content") -> DataFrame:
    """Add content_type, confidence, signals and all_results.

    Stateless and without a shuffle; runs unchanged on a stream (S6).
    """
    c = F.col(content)
    ordered = {t: DETECTORS[t] for t in TYPE_PRIORITY if t in DETECTORS}
    signal_columns = {f"_sig_{t}": matched_signals(c, d) for t, d in ordered.items()}
    if "json" not in ordered:
        signal_columns["_sig_json"] = _json_signals(c)
    staged = docs.withColumns(signal_columns)

    ranked = []
    for t, d in ordered.items():
        ranked.append(_ranked(TYPE_PRIORITY.index(t), _detection(d, F.col(f"_sig_{t}"))))
    if "json" not in ordered:
        found = _json_detection(c, F.col("_sig_json"))
        ranked.append(_ranked(TYPE_PRIORITY.index("json"), found))
    hits = F.filter(
        F.array_compact(F.array(*ranked)), lambda r: r["detection"]["confidence"] >= MIN_CONFIDENCE
    )
    results = F.transform(F.array_sort(hits), lambda r: r["detection"])
    nothing = F.array().cast(f"array<{DETECTION}>")
    staged = staged.withColumn("all_results", F.when(is_blank(c), nothing).otherwise(results))
    best = F.try_element_at("all_results", F.lit(1))
    return staged.withColumns(
        {
            "content_type": F.coalesce(best["content_type"], F.lit("unknown")),
            "confidence": F.when(is_blank(c), F.lit(1.0)).otherwise(
                F.coalesce(best["confidence"], F.lit(0.0))
            ),
            "signals": F.coalesce(best["signals"], F.array().cast("array<string>")),
        }
    ).drop(*signal_columns)


def _ranked(priority: int, detection: Column) -> Column:
    """Sorts by confidence descending, then by type priority."""
    return F.when(
        detection.isNotNull(),
        F.struct(
            (-detection["confidence"]).alias("order"),
            F.lit(priority).alias("priority"),
            detection.alias("detection"),
        ),
    )


def low_confidence(detected: Column, threshold: float = 0.5) -> Column:
    """Is the automatic choice worth a warning?"""
    return detected < threshold


def guess_type(content: Column) -> Column:
    """Cheap guess from the first 500 and last 100 characters."""
    head = trim(F.substring(content, 1, 500))
    tail = trim(F.substring(content, -100, 100))
    words = (
        r"(?:function|class|const|let|var|import|export|return|if|for|while)"
    )
    code_hits = (
        head.rlike(WS + words + WE).cast("int")
        + head.rlike(r"[{;}]").cast("int")
        + head.rlike(r"(?m)^\s*//").cast("int")
        + head.rlike(r"(?m)^\s*/\*").cast("int")
    )
    json_like = (
        head.rlike(r"\A\s*[\[{]") & tail.rlike(r"[\]}]\s*\z") & (F.length(content) <= 100_000)
    )
    return (
        F.when(is_blank(content), F.lit("unknown"))
        .when(json_like & is_json(content), F.lit("json"))
        .when(code_hits >= 3, F.lit("code"))
        .when(
            head.rlike(r"(?m)^#{1,6}\s")
            | head.rlike(r"\*\*.*\*\*")
            | head.rlike(r"\[.*\]\(.*\)"),
            F.lit("markdown"),
        )
        .when(
            head.rlike(rf"(?i){WS}(?:INFO|WARN|ERROR|DEBUG|TRACE|FATAL){WE}")
            | head.rlike(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"),
            F.lit("log"),
        )
        .when(
            head.rlike(rf"(?i){WS}(?:PASS|FAIL|SKIP|OK|passed|failed|tests?){WE}")
            | head.rlike(rf"(?i){WS}(?:assert|expect){WE}"),
            F.lit("test_output"),
        )
        .otherwise(F.lit("unknown"))
    )


