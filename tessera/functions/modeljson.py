"""Reading what a language model answered: tolerant JSON, then typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import DOMAINS, MAX_TAGS, UNKNOWN_DOMAIN
from tessera.functions.arrays import dedupe_ci, let, no_strings
from tessera.functions.vectors import clamp

WHOLE = r"^\s*[+-]?\d+(?:\.0+)?\s*$"


def kind(value: Column) -> Column:
    """JSON type name of a variant; null when the key is absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def answer_fields(answer: Column) -> Column:
    """Fields of the JSON object in a model answer as map<string,variant>.

    The object is the whole text, else its outermost braces; anything else gives an empty map.
    """
    inner = F.try_parse_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0))
    none = F.expr("cast(map() as map<string,variant>)")

    def fields(found: Column) -> Column:
        return F.when(kind(found) == "OBJECT", found.cast("map<string,variant>")).otherwise(none)

    return let(F.coalesce(F.try_parse_json(answer), inner), fields)


def text_of(value: Column) -> Column:
    """A scalar as text: null is 'None', booleans are capitalised."""
    k = kind(value)
    return (
        F.when(k == "VOID", F.lit("None"))
        .when(k == "BOOLEAN", F.initcap(value.cast("string")))
        .when(k.isin("OBJECT", "ARRAY"), F.to_json(value))
        .otherwise(value.try_cast("string"))
    )


def _is_truthy(value: Column) -> Column:
    k = kind(value)
    return (
        F.when(value.isNull() | (k == "VOID"), False)
        .when(k == "STRING", value.try_cast("string") != "")
        .when(k == "BOOLEAN", value.try_cast("boolean"))
        .when(k.isin("OBJECT", "ARRAY"), ~F.to_json(value).isin("{}", "[]"))
        .otherwise(F.coalesce(value.try_cast("double") != 0, F.lit(True)))
    )


def text_list(value: Column) -> Column:
    """List items as text; anything that is not a list gives an empty list."""
    items = F.transform(value.try_cast("array<variant>"), text_of)
    return F.when(kind(value) == "ARRAY", items).otherwise(no_strings())


def coerce_tags(found: Column, hint: Column, default_confidence: float, allowed=DOMAINS) -> Column:
    """Struct(domain, entity_tags, key_fields, confidence) of the fields of a tagging answer.

    With a whitelist a foreign domain falls back to the hint; without one it is kept.
    """
    hint = F.coalesce(hint, F.lit(UNKNOWN_DOMAIN))
    named = F.when(_is_truthy(found["domain"]), F.lower(F.trim(text_of(found["domain"]))))
    if allowed is None:
        domain = F.when(named != "", named).otherwise(hint)
    else:
        domain = F.when(named.isin(list(allowed)), named).otherwise(hint)
    extra = F.when(
        kind(found["key_fields"]) == "OBJECT",
        F.from_json(F.to_json(found["key_fields"]), "map<string,string>"),
    )
    sure = F.coalesce(
        F.when(kind(found["confidence"]) == "BOOLEAN", found["confidence"].try_cast("boolean").cast("double"))
        .when(~kind(found["confidence"]).isin("OBJECT", "ARRAY", "VOID"), found["confidence"].try_cast("double")),
        F.lit(float(default_confidence)),
    )
    return F.struct(
        domain.alias("domain"),
        dedupe_ci(text_list(found["entity_tags"]), MAX_TAGS).alias("entity_tags"),
        F.coalesce(extra, F.expr("cast(map() as map<string,string>)")).alias("key_fields"),
        clamp(sure, 0.0, 1.0).alias("confidence"),
    )


def whole_number(value: Column) -> Column:
    """Integer reading of a JSON scalar, null when it has none."""
    k = kind(value)
    number = value.try_cast("double")
    return (
        F.when(k == "BOOLEAN", value.try_cast("boolean").cast("int"))
        .when(
            k == "STRING",
            F.when(value.try_cast("string").rlike(WHOLE), number.try_cast("int")),
        )
        .when(k.isin("OBJECT", "ARRAY", "VOID"), F.lit(None).cast("int"))
        .when(number == F.floor(number), number.try_cast("int"))
    )
