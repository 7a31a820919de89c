"""Array and map expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip


def no_strings() -> Column:
    return F.array().cast("array<string>")


def strings(values: Column) -> Column:
    """Trimmed, non-blank strings of a list; null list and null items vanish."""
    present = F.filter(F.coalesce(values, no_strings()), lambda v: v.isNotNull())
    return F.filter(F.transform(present, strip), lambda v: v != "")


def let(value: Column, body) -> Column:
    """`body` applied to `value`, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dedupe_ci(values: Column, limit: int | None = None) -> Column:
    """Case-insensitive de-duplication that keeps the first spelling and the order."""

    def with_keys(items: Column) -> Column:
        return F.struct(items.alias("items"), F.transform(items, F.lower).alias("keys"))

    def first_spellings(s: Column) -> Column:
        keys = F.array_distinct(s["keys"])
        if limit is not None:
            keys = F.slice(keys, 1, limit)
        return F.transform(keys, lambda k: F.get(s["items"], (F.array_position(s["keys"], k) - 1).cast("int")))

    return let(let(strings(values), with_keys), first_spellings)


def unique(values: Column, lower: bool = False) -> Column:
    """Trimmed, non-blank, distinct strings in first-seen order."""
    items = strings(values)
    return F.array_distinct(F.transform(items, F.lower) if lower else items)


def lower_set(*columns: Column) -> Column:
    """Lower-cased distinct union of scalar and list columns, without empty strings."""
    joined = F.concat(*[F.coalesce(c, no_strings()) for c in columns])
    present = F.filter(joined, lambda v: v.isNotNull() & (v != ""))
    return F.array_distinct(F.transform(present, F.lower))


def as_list(value: Column) -> Column:
    """A list of one item, or an empty list for null."""
    return F.when(value.isNull(), no_strings()).otherwise(F.array(value))


def only_allowed(values: Column, allowed) -> Column:
    """Items whose lower-cased form is in a fixed whitelist."""
    names = [a.lower() for a in allowed]
    return F.filter(values, lambda v: F.lower(v).isin(names))


def map_union(left: Column, right: Column) -> Column:
    """Union of two maps; the right side wins on equal keys."""
    empty = F.expr("cast(map() as map<string,string>)")
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)


def first_present(values: Column) -> Column:
    return F.get(values, F.lit(0))
