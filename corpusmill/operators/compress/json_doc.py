"""JSON by its keys, special fields at any depth and array samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import let, token_count, truncate_to_tokens
from corpusmill.functions.values import kind_of, parse_json, type_name
from corpusmill.operators.compress.common import (
    budgeted, facts_of, head, line, lines_of, result, texts, when_lines,
)

# Field names that are always worth keeping.
SPECIAL = (
    "error", "errors", "status", "code", "message", "id", "name", "type", "kind", "requestId",
    "traceId", "timestamp", "version",
)
MEMBERS = "map<string,variant>"


def _members(v: Column) -> Column:
    """(key, value) entries of an object, empty for anything else."""
    empty = F.array().cast("array<struct<key:string,value:variant>>")
    return F.coalesce(F.map_entries(F.try_variant_get(v, "$", MEMBERS)), empty)


def _items(v: Column) -> Column:
    return F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")
    )


def _short(text: Column) -> Column:
    cut = F.concat(F.lit('"'), F.substring(text, 1, 80), F.lit('..." ('), F.length(text), F.lit(" chars total)"))
    return F.when(F.length(text) <= 80, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(cut)


def _sample(v: Column) -> Column:
    def of_kind(kind: Column) -> Column:
        return (
            F.when(kind == "VOID", F.lit("null"))
            .when(kind == "STRING", _short(F.try_variant_get(v, "$", "string")))
            .when(kind.startswith("ARRAY"), let(_items(v), of_array))
            .when(kind.startswith("OBJECT"), let(F.transform(_members(v), lambda e: e["key"]), of_object))
            .otherwise(F.to_json(v))
        )

    def of_array(items: Column) -> Column:
        more = F.when(F.size(items) > 2, F.concat(F.lit(", ... ("), F.size(items), F.lit(" items)"))).otherwise("")
        shown = F.transform(head(items, 2), lambda x: F.substring(F.to_json(x), 1, 80))
        return F.concat(F.lit("["), F.array_join(shown, ", "), more, F.lit("]"))

    def of_object(keys: Column) -> Column:
        more = F.when(F.size(keys) >= 5, ", ...").otherwise("")
        return F.concat(F.lit("{ "), F.array_join(head(keys, 5), ", "), more, F.lit(" }"))

    return let(kind_of(v), of_kind)


def _is_special(key: Column) -> Column:
    low = F.lower(key)
    return key.isin(*SPECIAL) | low.contains("error") | low.contains("status") | low.contains("id")


# Fixed value: how deep the JSON parser goes; a text nested deeper is invalid JSON.
MAX_NESTING = 1000
NODE = (
    "struct<ord:array<int>,path:string,like:string,outer:boolean,direct:boolean,member:boolean,special:boolean,"
    "shown:boolean,value:variant>"
)
FOUND = "struct<like:string,value:string,ord:array<int>,path:string,shown:boolean>"
WALK = f"struct<level:array<{NODE}>,found:array<{FOUND}>,folded_arrays:int,folded_texts:int>"


def _children(n: Column, members: Column, items: Column) -> Column:
    """The fields of an object or the items of an array, one level down.

    ``like`` is the path without the place in the innermost array; ``outer``
    says that no array is above, ``direct`` that the value is one of the first
    five items of an array that has no array above.
    """

    def below(parent: Column, key: Column) -> Column:
        return F.when(F.length(parent) > 0, F.concat(parent, F.lit("."), key)).otherwise(key)

    def field(e: Column, i: Column) -> Column:
        key = e["key"]
        special = _is_special(key)
        return F.struct(
            F.concat(n["ord"], F.array(i)).alias("ord"), below(n["path"], key).alias("path"),
            below(n["like"], key).alias("like"), n["outer"].alias("outer"), F.lit(False).alias("direct"),
            F.lit(True).alias("member"), special.alias("special"),
            ((n["outer"] & special) | (n["direct"] & key.isin(*SPECIAL))).alias("shown"), e["value"].alias("value"))

    def item(v: Column, i: Column) -> Column:
        return F.struct(
            F.concat(n["ord"], F.array(i)).alias("ord"),
            F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"),
            F.concat(n["path"], F.lit("[*]")).alias("like"), F.lit(False).alias("outer"),
            (n["outer"] & n["member"] & (i < 5)).alias("direct"), F.lit(False).alias("member"),
            F.lit(False).alias("special"), F.lit(False).alias("shown"), v.alias("value"))

    return F.concat(
        F.transform(members, field).cast(f"array<{NODE}>"), F.transform(items, item).cast(f"array<{NODE}>"))


def _next_level(walk: Column) -> Column:
    """Notes what the values of a level are and goes on with what they hold."""
    opened = F.transform(
        walk["level"],
        lambda n: F.struct(n.alias("n"), _members(n["value"]).alias("members"), _items(n["value"]).alias("items")))

    def go(nodes: Column) -> Column:
        special = F.transform(
            F.filter(walk["level"], lambda n: n["special"]),
            lambda n: F.struct(
                F.when(n["outer"], n["ord"].cast("string")).otherwise(n["like"]).alias("like"),
                F.to_json(n["value"]).alias("value"), n["ord"].alias("ord"), n["path"].alias("path"),
                n["shown"].alias("shown")))
        counted = lambda o: o["n"]["outer"] & o["n"]["member"]
        long_arrays = F.filter(nodes, lambda o: counted(o) & (F.size(o["items"]) > 5))
        long_texts = F.filter(nodes, lambda o: F.coalesce(
            counted(o) & (F.size(o["items"]) == 0) & (F.size(o["members"]) == 0)
            & (F.length(F.try_variant_get(o["n"]["value"], "$", "string")) > 200), F.lit(False)))
        return F.struct(
            F.flatten(F.transform(nodes, lambda o: _children(o["n"], o["members"], o["items"]))).alias("level"),
            F.concat(walk["found"], special).alias("found"),
            (walk["folded_arrays"] + F.size(long_arrays)).alias("folded_arrays"),
            (walk["folded_texts"] + F.size(long_texts)).alias("folded_texts")).cast(WALK)

    return F.when(F.size(walk["level"]) > 0, let(opened, go)).otherwise(walk)


def walked(v: Column, content: Column) -> Column:
    """special fields, folded_arrays and folded_texts of a whole JSON value.

    The value is opened level by level until nothing is left to open, so depth
    and length of arrays are not limited; a level holds each value once. There
    are no more levels than opening brackets in the text. Special fields come
    in document order; within one array a field with the value of an earlier
    item is left out. Arrays of over five items and texts of over 200
    characters are counted where no array is above them.
    """
    opening = F.length(content) - F.length(F.translate(content, "[{", ""))
    root = F.struct(
        F.array().cast("array<int>").alias("ord"), F.lit("").alias("path"), F.lit("").alias("like"),
        F.lit(True).alias("outer"), F.lit(False).alias("direct"), F.lit(False).alias("member"),
        F.lit(False).alias("special"), F.lit(False).alias("shown"), v.alias("value"))
    start = F.struct(
        F.array(root).alias("level"), F.array().cast(f"array<{FOUND}>").alias("found"),
        F.lit(0).alias("folded_arrays"), F.lit(0).alias("folded_texts")).cast(WALK)
    rounds = F.sequence(F.lit(0), F.least(opening, F.lit(MAX_NESTING)).cast("int"))
    done = F.aggregate(rounds, start, lambda walk, _round: _next_level(walk))

    def first_of_equal(fields: Column) -> Column:
        def repeats(f: Column, i: Column) -> Column:
            before = F.get(fields, i - 1)
            return (i > 0) & (before["like"] == f["like"]) & (before["value"] == f["value"])

        kept = F.filter(fields, lambda f, i: ~F.coalesce(repeats(f, i), F.lit(False)))
        in_order = F.array_sort(F.transform(kept, lambda f: F.struct(
            f["ord"].alias("ord"), f["path"].alias("path"), f["value"].alias("value"), f["shown"].alias("shown"))))
        return in_order

    return let(done, lambda d: F.struct(
        let(F.array_sort(d["found"]), first_of_equal).alias("special"),
        d["folded_arrays"].alias("folded_arrays"), d["folded_texts"].alias("folded_texts")))


def extract_info(v: Column, content: Column) -> Column:
    """Top-level keys keep the text's order; a VARIANT sorts those further down."""
    is_array = kind_of(v).startswith("ARRAY")
    members = F.try_variant_get(v, "$", MEMBERS)
    entries = F.transform(
        F.json_object_keys(content),
        lambda k: F.struct(k.alias("key"), F.try_element_at(members, k).alias("value")),
    )
    top = F.transform(
        F.coalesce(entries, _members(v)),
        lambda e: F.struct(
            e["key"].alias("key"), type_name(e["value"]).alias("type"), _sample(e["value"]).alias("sample"),
            e["value"].alias("value"),
        ),
    )

    def samples(keys: Column) -> Column:
        return F.transform(
            F.filter(keys, lambda k: k["type"].startswith("array")),
            lambda k: let(
                _items(k["value"]),
                lambda xs: F.struct(
                    k["key"].alias("key"),
                    F.size(xs).alias("total"),
                    F.transform(head(xs, 3), lambda x: F.to_json(x)).alias("samples"),
                ),
            ),
        )

    first_items = F.transform(
        head(_items(v), 3), lambda x, i: line("[", i, "]: ", type_name(x), " — ", _sample(x))
    )
    return let(walked(v, content), lambda w: let(top, lambda keys: F.struct(
        is_array.alias("is_array"),
        F.size(_items(v)).alias("total_items"),
        first_items.alias("items"),
        F.transform(keys, lambda k: F.struct(k["key"], k["type"], k["sample"])).alias("keys"),
        w["special"].alias("special"),
        samples(keys).alias("arrays"),
        w["folded_arrays"].alias("folded_arrays"),
        w["folded_texts"].alias("folded_texts"),
    )))


def render(i: Column) -> Column:
    n = F.size(i["keys"])
    shown = F.filter(i["special"], lambda s: s["shown"])
    array_view = lines_of(
        texts("## JSON Summary", "", line("- **Type:** Array (", i["total_items"], " items)"), ""),
        when_lines(F.size(i["items"]) > 0, F.concat(texts("### Sample Items", "```json"), i["items"], texts("```"))),
    )
    folded = F.concat_ws(
        ", ",
        F.when(i["folded_arrays"] > 0, line(i["folded_arrays"], " long arrays folded")),
        F.when(i["folded_texts"] > 0, line(i["folded_texts"], " long text fields folded")),
    )
    quote = lambda k, v: F.concat(F.lit('  "'), k, F.lit('": "'), v, F.lit('"'))
    object_view = lines_of(
        texts("## JSON Summary", "", "### Top-Level Keys", "", "| Key | Type | Sample |", "|-----|------|--------|"),
        F.transform(head(i["keys"], 30), lambda k: line("| `", k["key"], "` | `", k["type"], "` | ", k["sample"], " |")),
        when_lines(n > 30, texts(line("| ... | ... | *(", n - 30, " more keys)* |"))),
        texts("", "### Schema Shape", "```json", "{"),
        texts(F.array_join(F.transform(head(i["keys"], 20), lambda k: quote(k["key"], k["type"])), ",\n"), "}"),
        when_lines(n > 20, texts(line("  // ... ", n - 20, " more keys"))),
        texts("```", ""),
        when_lines(F.size(shown) > 0, F.concat(
            texts("### Special Fields (error / status / id)", "```json", "{"),
            texts(F.array_join(F.transform(
                head(shown, 15), lambda s: line('  "', s["path"], '": ', s["value"])), ",\n"), "}"),
            texts("```", ""))),
        F.flatten(F.transform(head(i["arrays"], 5), lambda a: F.concat(
            texts(line("### Array: `", a["key"], "` (", a["total"], " items)"), "```json"),
            a["samples"],
            when_lines(a["total"] > 3, texts(line("// ... (", a["total"] - 3, " more items folded)"))),
            texts("```", "")))),
        when_lines(F.length(folded) > 0, texts(line("- **Folded:** ", folded))),
    )
    return F.when(i["is_array"], array_view).otherwise(object_view)


def compress(content: Column, max_tokens: int, goal: Column) -> Column:
    broken = result(
        content, "Invalid JSON — returned original",
        F.lit("Failed to parse JSON — returning original content"),
    )

    def run(i: Column) -> Column:
        def finish(text: Column) -> Column:
            fits = token_count(text) <= max_tokens
            return result(
                F.when(fits, text).otherwise(truncate_to_tokens(text, max_tokens)),
                F.when(fits, line("JSON compressed: ", F.size(i["keys"]), " top-level keys, ",
                                  i["folded_arrays"], " arrays folded"))
                .otherwise("JSON compressed and trimmed"),
                F.when(~fits, F.lit("Trimmed JSON output to fit token budget")),
            )

        return let(render(i), finish)

    body = let(
        parse_json(content),
        lambda v: F.when(v.isNull(), broken).otherwise(let(extract_info(v, content), run)),
    )
    return budgeted(content, max_tokens, "JSON", body)


def facts(content: Column) -> Column:
    def rows(i: Column) -> Column:
        return facts_of(
            key=F.transform(i["keys"], lambda k: F.concat_ws("|", k["key"], k["type"])),
            special_field=F.transform(i["special"], lambda s: F.concat_ws("=", s["path"], s["value"])),
            array=F.transform(i["arrays"], lambda a: F.concat_ws("|", a["key"], a["total"].cast("string"))),
            folded_arrays=F.array(i["folded_arrays"].cast("string")),
            folded_texts=F.array(i["folded_texts"].cast("string")),
        )

    empty = F.array().cast("array<struct<kind:string,ord:int,value:string>>")
    return let(
        parse_json(content), lambda v: F.when(v.isNull(), empty).otherwise(let(extract_info(v, content), rows))
    )
