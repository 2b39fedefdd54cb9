"""JSON text as VARIANT: validity, type names, tolerant decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import let, trim


def parse_json(c: Column) -> Column:
    """Strict parse to VARIANT, null when the text is not exactly one value.

    The text is wrapped as a one-element array because the parser alone
    accepts trailing text after a complete value.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), trim(c), F.lit("]")))
    return let(
        wrapped,
        lambda v: F.when(
            F.try_variant_get(v, "$[0]", "variant").isNotNull()
            & F.try_variant_get(v, "$[1]", "variant").isNull(),
            F.try_variant_get(v, "$[0]", "variant"),
        ),
    )


def is_json(c: Column) -> Column:
    return parse_json(c).isNotNull()


def decode_string_array(c: Column) -> Column:
    """JSON text to array<string>; anything else is null."""
    return F.from_json(c, "array<string>")


def decode_string_map(c: Column) -> Column:
    """JSON object text to map<string,string>; anything else is null."""
    return F.from_json(c, "map<string,string>")


def kind_of(v: Column) -> Column:
    """OBJECT, ARRAY, VOID, STRING or another scalar's type; looks at one level only.

    ``schema_of_variant`` goes down into every value and overflows the stack on
    deep ones, so it is asked for scalars alone.
    """
    return (
        F.when(v.isNull(), F.lit("VOID"))
        .when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.lit("OBJECT"))
        .when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), F.lit("ARRAY"))
        .otherwise(F.schema_of_variant(v))
    )


def type_name(v: Column) -> Column:
    """The type name of a VARIANT (arrays by first item, two levels down)."""

    def scalar(s: Column) -> Column:
        return (
            F.when(s == "VOID", F.lit("null"))
            .when(s == "STRING", F.lit("string"))
            .when(s == "BOOLEAN", F.lit("boolean"))
            .when(s == "OBJECT", F.lit("object"))
            .when(s == "ARRAY", F.lit("array"))
            .otherwise(F.lit("number"))
        )

    def nested(value: Column, depth: int) -> Column:
        first = F.try_variant_get(value, "$[0]", "variant")
        if depth == 0:
            return scalar(kind_of(value))
        inner = let(first, lambda x: F.when(x.isNull(), F.lit("array")).otherwise(
            F.concat(F.lit("array<"), nested(x, depth - 1), F.lit(">"))))
        return let(kind_of(value), lambda k: F.when(k == "ARRAY", inner).otherwise(scalar(k)))

    return nested(v, 2)
