"""JSON in responses: strict parsing, recovery from prose, and JSON Schemas compiled to column expressions.

Duplicate keys need ``spark.sql.variant.allowDuplicateKeys``. The literals NaN and Infinity are not JSON here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = "~end~"
#: What a JSON value can begin with.
_BEGINNING = r'^[\[{"\-0-9tfn]'


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strict_value(text: Column) -> Column:
    """The variant that the whole text states; null unless it is exactly one JSON value.

    The text is framed by an array with a sentinel, as a parser alone accepts what follows a first value. A text that begins like no JSON
    value isn't parsed, as a failure costs much more than a parse, and no text is parsed twice.
    """
    plain = stripped(text)
    framed = F.try_parse_json(F.when(plain.rlike(_BEGINNING), F.concat(F.lit("["), plain, F.lit(f',"{_END}"]')))).try_cast("array<variant>")
    whole = lambda f: (F.size(f) == 2) & (F.try_variant_get(F.get(f, F.lit(1)), "$", "string") == _END)
    return F.get(F.transform(F.array(framed), lambda f: F.when(whole(f), F.get(f, F.lit(0)))), F.lit(0))


def is_strict_json(text: Column) -> Column:
    return F.coalesce(strict_value(text).isNotNull(), F.lit(False))


def extract_json(text: Column) -> Column:
    """The first that parses of: the whole text, a code fence, the outermost braces, the outermost brackets."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    spans = [F.regexp_substr(text, F.lit(p)) for p in (r"(?s)\{.*\}", r"(?s)\[.*\]")]
    return F.coalesce(*(strict_value(t) for t in (text, fence, *spans)))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_type(value: Column, name: str) -> Column:
    kind = _kind(value)
    number = F.try_variant_get(value, "$", "double")
    numeric = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE")
    return {
        "string": kind == "STRING",
        "boolean": kind == "BOOLEAN",
        "null": F.is_variant_null(value),
        "object": kind.startswith("OBJECT"),
        "array": kind.startswith("ARRAY"),
        "number": numeric,
        "integer": numeric & (number == F.rint(number)) & (F.abs(number) < float("inf")),
    }[name]


def matches_schema(value: Column, schema: dict) -> Column:
    """Whether a variant is valid under a JSON Schema of type, properties, required, items, minItems, maxItems and enum."""
    checks = []
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        any_of = F.lit(False)
        for name in names:
            any_of = any_of | F.coalesce(_is_type(value, name), F.lit(False))
        checks.append(any_of)
    if "enum" in schema:
        checks.append(F.try_variant_get(value, "$", "string").isin(*schema["enum"]))
    is_object, is_array = _is_type(value, "object"), _is_type(value, "array")
    for key in schema.get("required", ()):
        checks.append(~is_object | F.try_variant_get(value, f"$.{key}", "variant").isNotNull())
    for key, part in schema.get("properties", {}).items():
        found = F.try_variant_get(value, f"$.{key}", "variant")
        checks.append(~is_object | found.isNull() | matches_schema(found, part))
    elements = value.try_cast("array<variant>")
    if "minItems" in schema:
        checks.append(~is_array | (F.size(elements) >= schema["minItems"]))
    if "maxItems" in schema:
        checks.append(~is_array | (F.size(elements) <= schema["maxItems"]))
    if "items" in schema:
        checks.append(~is_array | F.forall(elements, lambda x: matches_schema(x, schema["items"])))
    whole = F.lit(True)
    for check in checks:
        whole = whole & F.coalesce(check, F.lit(False))
    return F.coalesce(value.isNotNull() & whole, F.lit(False))


def format_passed(value: Column, schema: dict) -> Column:
    """Whether the value recovered from a text (a column, so that it is parsed once) isn't null and is valid."""
    return F.coalesce(~F.is_variant_null(value), F.lit(False)) & matches_schema(value, schema)
