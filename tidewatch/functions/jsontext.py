"""Reading JSON held as text, with the warehouse's scalar-only value rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_JSON_SPACE = " \t\r\n"


def _scalar(value: Column) -> Column:
    """A scalar variant as text; objects, arrays and JSON null give SQL null."""
    kind = F.schema_of_variant(value)
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID")
    return F.when(~nested, F.try_variant_get(value, "$", "string"))


def json_array(value: Column) -> Column:
    """Elements of a JSON array as variants; null when the text is not a JSON array."""
    return F.when(value.rlike(r"^\s*\["), F.try_parse_json(value).try_cast("array<variant>"))


def json_scalars(value: Column) -> Column:
    """The scalar elements of a JSON array as text, never null, without null elements."""
    texts = F.filter(F.transform(json_array(value), _scalar), lambda text: text.isNotNull())
    return F.coalesce(texts, F.array().cast("array<string>"))


def json_scalar(value: Column) -> Column:
    return _scalar(F.try_parse_json(value))


def json_string(value: Column) -> Column:
    """The text of a JSON string; null for JSON of any other type.

    A string without escapes is just what stands between its quotes, so only strings with escapes
    are parsed; what does not end with the first quote left unescaped is malformed and null.
    """
    text = F.btrim(value, F.lit(_JSON_SPACE))
    plain = F.substring(text, F.lit(2), F.length(text) - 2)
    closed = text.rlike(r'(?s)^"(?:[^"\\]++|\\.)*+"$')
    return F.when(closed, F.when(F.contains(text, F.lit("\\")), json_scalar(text)).otherwise(plain))


def json_field(value: Column, path: str) -> Column:
    """A scalar at ``path`` of a variant as text."""
    inner = F.try_variant_get(value, path, "variant")
    return _scalar(inner)


def is_empty_json(value: Column) -> Column:
    """SQL null, JSON null or an object without members, told without parsing."""
    return F.coalesce(value.rlike(r"^\s*(?:null|\{\s*\})\s*$"), F.lit(True))


def safe_bigint(text: Column) -> Column:
    return text.try_cast("bigint")


def safe_date(text: Column) -> Column:
    """A full ``y-m-d`` date, else null (Spark alone would also take ``y`` and ``y-m``)."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))
