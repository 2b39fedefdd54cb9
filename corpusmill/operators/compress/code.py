"""Source code as an outline with line numbers.

One fold over the lines follows the brace depth (E5): at depth zero lines are
classified, inside a body they are counted, and only what the outline shows is
kept. A type without a block counts once, and a body opened and closed on one
line ends there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import ascii_words, let, token_count, trim
from corpusmill.operators.compress.common import (
    FACT, budgeted, facts_of, first_of, head, ladder, line, lines_of, none, one, or_else, result,
    extract, texts, when_lines,
)

# Line classes of TypeScript-like code.
IMPORT = ascii_words(r"^\s*(?:import\b|(?:const|let|var)\s+\w+\s*=\s*require\()")
EXPORT = (
    r"^\s*export\s+(?:default\s+)?"
    r"(?:(?:const|let|var|function|class|interface|type|enum|abstract|async)\s+)?"
)
EXPORT_BLOCK = r"^\s*export\s+\{[^}]+\}\s*;"
TYPE_DEF = r"^\s*(?:export\s+)?(?:interface|type)\s+\w+(?![A-Za-z0-9_])"
FUNCTION = (
    r"^\s*(?:(?:export\s+)?(?:async\s+)?function\s+\w+"
    r"|(?:(?:public|private|protected|static|async)\s+)*\s*(?:get|set)\s+\w+"
    r"|[\w$]+\s*[:=]\s*(?:async\s*)?\([^)]*\)\s*(?:=>|:))"
)
CLASS = r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+\w+"
METHOD = (
    r"^\s*(?:public\s+)?(?:async\s+)?(?:static\s+)?(?:get\s+|set\s+)?(\w+)\s*\([^)]*\)\s*(?::\s*\S+)?\s*\{"
)
TODO = r"(?i)//.*(?:TODO|FIXME|HACK|XXX|OPTIMIZE|BUG)(?![A-Za-z0-9_])"
COMMENT = r"^\s*(?://|/\*|\*|\*/)"
BLANK = r"^\s*\z"
CONSTANT = r"^\s*(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*['\"`0-9(\-]"
RELEVANT = ascii_words(
    r"(?i)\b(?:try|catch|finally|throw|error|auth|login|logout|token|session|query|sql|db|database|transaction"
    r"|validate|sanitize|encrypt|hash|password|secret|api|endpoint)\b"
)
FILE_NAME = r"(?i)(?:@file|@module|File:)\s*(.+)"
MAX_TYPE_LINES, MAX_BODY_LINES = 15, 29


def _fact(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("ord"), value.alias("value"))


def _numbered(at: Column, text: Column) -> Column:
    return line("L", at + 1, ": ", text)


def outline(ls: Column) -> Column:
    """struct(facts, folded) of a file's lines."""
    state = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit("").alias("block"),
        F.lit(False).alias("open"), F.lit(False).alias("relevant"), F.lit(False).alias("method"),
        F.lit(0).alias("rows"), F.lit("").alias("title"), none().alias("body"),
        F.array().cast(FACT).alias("facts"), F.lit(0).alias("folded"),
    )

    def new(s: Column, **changes: Column) -> Column:
        names = ("depth", "block", "open", "relevant", "method", "rows", "title", "body", "facts", "folded")
        return F.struct(
            (s["at"] + 1).alias("at"), *[changes.get(n, s[n]).alias(n) for n in names]
        )

    def step(s: Column, x: Column) -> Column:
        delta = (F.regexp_count(x, F.lit(r"\{")) - F.regexp_count(x, F.lit(r"\}"))).cast("int")
        t, at = trim(x), s["at"]
        todo = F.when(x.rlike(TODO), F.array(_fact("todo", _numbered(at, x)))).otherwise(
            F.array().cast(FACT)
        )
        label = _numbered(at, t)
        braced = x.contains("{")

        def add(*facts: Column) -> Column:
            return F.concat(s["facts"], F.array(*facts)).cast(FACT)

        def opened(kind: str, facts: Column) -> Column:
            # a head without a brace waits for it; a closed one-liner ends at once
            ends = braced & (delta <= 0)
            done = new(s, facts=facts, folded=s["folded"] + F.lit(0 if kind == "type" else 1))
            body = new(
                s, depth=F.greatest(delta, F.lit(0)), block=F.lit(kind), open=braced,
                relevant=F.lit(False), method=F.lit(False), rows=F.lit(0),
                title=label, body=none(), facts=facts,
            )
            return F.when(ends, done).otherwise(body)

        def single(facts: Column) -> Column:
            return new(s, facts=facts)

        type_line = F.when(
            braced & (delta > 0), opened("type", s["facts"])
        ).otherwise(single(add(_fact("type", label))))
        function_line = F.when(
            braced, opened("function", add(_fact("function", label), _fact("api", label)))
        ).otherwise(single(add(_fact("function", label), _fact("api", label))))
        loose = F.concat(
            s["facts"], todo,
            F.when(x.rlike(RELEVANT), F.array(_fact("relevant", _numbered(at, x)))).otherwise(
                F.array().cast(FACT)
            ),
        ).cast(FACT)
        top = (
            F.when(x.rlike(BLANK) | x.rlike(COMMENT), new(s, facts=F.concat(s["facts"], todo).cast(FACT)))
            .when(x.rlike(IMPORT), single(add(_fact("import", label))))
            .when(x.rlike(TYPE_DEF), type_line)
            .when(x.rlike(EXPORT_BLOCK), single(add(_fact("export", label), _fact("api", label))))
            .when(x.rlike(CLASS), opened("class", add(_fact("class", label))))
            .when(x.rlike(FUNCTION), function_line)
            .when(x.rlike(EXPORT), single(add(_fact("export", label))))
            .when(x.rlike(CONSTANT), single(add(_fact("api", label))))
            .otherwise(new(s, facts=loose))
        )

        depth = s["depth"] + delta
        closed = (s["open"] | braced) & (depth <= 0)
        open_ = s["open"] | braced

        kept = F.when(s["rows"] < MAX_TYPE_LINES, F.array_append(s["body"], x)).otherwise(s["body"])
        rows = s["rows"] + 1
        whole = F.concat(s["title"], F.lit("\n"), F.array_join(kept, "\n"))
        short = F.concat(s["title"], line(" {\n  /* ... ", rows - 1, " lines ... */\n}"))
        small = rows <= MAX_TYPE_LINES
        in_type = F.when(
            closed,
            new(s, depth=F.lit(0), block=F.lit(""), body=none(), rows=F.lit(0),
                facts=add(_fact("type", F.when(small, whole).otherwise(short))),
                folded=s["folded"] + F.when(small, 0).otherwise(1)),
        ).otherwise(new(s, depth=depth, open=open_, body=kept, rows=rows))

        hot = s["relevant"] | x.rlike(RELEVANT)
        shown = F.when(
            s["rows"] < MAX_BODY_LINES, F.array_append(s["body"], _numbered(at, x))
        ).otherwise(s["body"])
        relevant_facts = F.concat(
            s["facts"],
            F.transform(shown, lambda b: _fact("relevant", b)),
            F.when(
                rows > MAX_BODY_LINES,
                F.array(_fact("relevant", line("  /* ... ", rows - MAX_BODY_LINES, " more lines ... */"))),
            ).otherwise(F.array().cast(FACT)),
        ).cast(FACT)
        body_todo = F.concat(s["facts"], todo).cast(FACT)
        in_function = F.when(
            closed,
            new(s, depth=F.lit(0), block=F.lit(""), body=none(), rows=F.lit(0),
                facts=F.when(s["relevant"], relevant_facts).otherwise(s["facts"]),
                folded=s["folded"] + F.when(s["relevant"], 0).otherwise(1)),
        ).otherwise(new(s, depth=depth, open=open_, relevant=hot, body=shown, rows=rows, facts=body_todo))

        is_method = (
            s["open"] & (s["depth"] == 1) & x.rlike(METHOD)
            & ~x.contains("private") & ~x.contains("protected")
        )
        signature = _numbered(at, F.regexp_replace(t, r"\s*\{.*", " { /* ... */ }"))
        method_facts = F.concat(
            s["facts"],
            F.when(is_method, F.array(_fact("api", signature))).otherwise(F.array().cast(FACT)),
            todo,
        ).cast(FACT)
        ends_method = s["method"] & (depth <= 1)
        fold = (
            F.when(is_method & (depth <= 1), 1)
            .when(ends_method & ~s["relevant"], 1)
            .otherwise(0)
        )
        in_class = F.when(
            closed, new(s, depth=F.lit(0), block=F.lit(""), method=F.lit(False), folded=s["folded"] + fold)
        ).otherwise(
            new(s, depth=depth, open=open_, facts=method_facts,
                method=F.when(is_method, depth > 1).when(ends_method, False).otherwise(s["method"]),
                relevant=F.when(is_method, False).otherwise(s["method"] & hot),
                folded=s["folded"] + fold)
        )
        return (
            F.when(s["block"] == "type", in_type)
            .when(s["block"] == "function", in_function)
            .when(s["block"] == "class", in_class)
            .otherwise(top)
        )

    return F.aggregate(
        ls, state, step, lambda s: F.struct(s["facts"].alias("facts"), s["folded"].alias("folded"))
    )


def _unique(items: Column) -> Column:
    """Drop lines that repeat an earlier one apart from the line number."""
    keys = F.transform(items, lambda x: trim(F.regexp_replace(x, r"^L\d+:\s*", "")))
    return let(keys, lambda k: F.filter(items, lambda _x, i: F.array_position(k, F.get(k, i)) == i + 1))


def extract_info(ls: Column) -> Column:
    def build(o: Column) -> Column:
        def of(kind: str) -> Column:
            return F.transform(F.filter(o["facts"], lambda f: f["kind"] == kind), lambda f: f["value"])

        return F.struct(
            trim(first_of(extract(head(ls, 10), FILE_NAME))).alias("file"),
            F.size(ls).alias("lines"),
            _unique(of("import")).alias("imports"), _unique(of("export")).alias("exports"),
            _unique(of("todo")).alias("todos"), of("type").alias("types"),
            of("function").alias("functions"), of("class").alias("classes"),
            _unique(of("api")).alias("apis"), _unique(of("relevant")).alias("relevant"),
            o["folded"].alias("folded"),
        )

    return let(outline(ls), build)


# Imports, APIs, types, TODOs and relevant lines of ever shorter renderings.
STEPS = ((30, 25, 10, 15, 20), (10, 15, 10, 15, 0), (5, 8, 5, 6, 0), (3, 5, 2, 4, 0))


def render(i: Column, limits: Column) -> Column:
    relevant = limits["relevant"]

    def block(title: str, items: Column, limit: Column, what: str | None) -> Column:
        n = F.size(items)
        shown = F.when(n > 0, head(items, limit)).otherwise(texts("// (none detected)"))
        more = none() if what is None else when_lines(n > limit, texts(line("// ... ", n - limit, f" more {what}")))
        return F.concat(texts(title, "```ts"), shown, more, texts("```", ""))

    n = F.size(i["relevant"])
    return lines_of(
        texts("## Code Context Summary", "", line("- **File:** `", or_else(i["file"], "(not detected)"), "`"),
              line("- **Total Lines:** ", i["lines"]), ""),
        block("### Imports", i["imports"], limits["imports"], "imports"),
        block("### Exports", i["exports"], F.lit(20), None),
        when_lines(F.size(i["todos"]) > 0, F.concat(
            texts("### TODO / FIXME / HACK", "```"), head(i["todos"], limits["todos"]), texts("```", ""))),
        block("### Types / Interfaces", i["types"], limits["types"], "type definitions"),
        block("### Public APIs", i["apis"], limits["apis"], "public APIs"),
        when_lines((n > 0) & (relevant > 0), F.concat(
            texts("### Relevant Blocks (error handling / auth / queries)", "```ts"),
            head(i["relevant"], relevant),
            when_lines(n > relevant, texts(line("// ... ", n - relevant, " more relevant lines"))),
            texts("```", ""))),
        texts(line("- **Functions Folded:** ", i["folded"])),
    )


def compress(content: Column, max_tokens: int, goal: Column) -> Column:
    def run(i: Column) -> Column:
        steps = [dict(zip(("imports", "apis", "types", "todos", "relevant"), v)) for v in STEPS]
        text = ladder(steps, lambda limits: render(i, limits), max_tokens)
        return let(text, lambda t: result(
            t,
            line("Code compressed: ", F.size(i["imports"]), " imports, ", F.size(i["apis"]),
                 " public APIs, ", i["folded"], " functions folded"),
            F.when(token_count(t) >= max_tokens, F.lit("Trimmed code output to fit token budget")),
        ))

    body = let(F.split(content, "\n"), lambda ls: let(extract_info(ls), run))
    return budgeted(content, max_tokens, "Code", body)


def facts(content: Column) -> Column:
    def rows(i: Column) -> Column:
        return facts_of(
            file=one(i["file"]), imports=i["imports"], exports=i["exports"], type=i["types"],
            function=i["functions"], classes=i["classes"], api=i["apis"], todo=i["todos"],
            relevant=i["relevant"], folded=F.array(i["folded"].cast("string")),
        )

    return let(F.split(content, "\n"), lambda ls: let(extract_info(ls), rows))
