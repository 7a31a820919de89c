"""String expressions (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four information separators.
SPACE = r"(?U)[\s\x1c-\x1f]"
# Runs that are not already one plain blank, so ordinary prose is scanned without being rebuilt.
LOOSE_SPACE = r"(?U)[\s\x1c-\x1f]{2,}|[\s\x1c-\x1f&&[^ ]]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_\-]*"
PHRASE = (
    r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?:(?U:[\s\x1c-\x1f]+)[A-Z][a-z&'\-]+){0,3}(?![\p{L}\p{N}_])"
)


def clean(text: Column) -> Column:
    """Collapse every run of white space to one blank and trim; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), LOOSE_SPACE, " "))


def strip(text: Column) -> Column:
    """Remove white space at both ends only."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def tokens(text: Column) -> Column:
    """ASCII word tokens in order, lower-cased after matching."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, F.lower)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_BREAK)


def non_blank_lines(text: Column) -> Column:
    return F.filter(split_lines(text), lambda line: ~is_blank(line))


def contains_any(text: Column, words) -> Column:
    """True when the text holds one of a fixed list of words."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def preview(text: Column, limit: int) -> Column:
    """Cleaned text, cut to `limit` characters with an ellipsis when longer."""
    value = clean(text)
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("..."))).otherwise(value)


def title_from_stem(stem: Column) -> Column:
    """Title case: a letter that follows no letter is a capital, all others are small."""
    letters = F.regexp_extract_all(F.lower(F.replace(stem, F.lit("_"), F.lit(" "))), F.lit(r"(?s)\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(letters, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def split_path_value(line: Column) -> Column:
    """(path, value) of a line at its first colon; value is trimmed, null without colon."""
    parts = F.split(line, ":", 2)
    return F.struct(
        F.get(parts, F.lit(0)).alias("path"),
        strip(F.get(parts, F.lit(1))).alias("value"),
    )


def capitalised_phrases(text: Column) -> Column:
    """Runs of one to four capitalised words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHRASE), F.lit(0))


def restore_casing(tag: Column, text: Column) -> Column:
    """Spelling of the first case-insensitive occurrence of `tag` in `text`, else `tag`."""
    at = F.position(F.lower(tag), F.lower(text))
    return F.when(at > 0, F.substring(text, at, F.length(tag))).otherwise(tag)


def numbered_id(source_id: Column, order: Column, text: Column, prefix: int) -> Column:
    """Stable chunk id: SHA-1 over source, position and the head of the text."""
    key = F.concat(
        source_id, F.lit(":"), order.cast("string"), F.lit(":"), F.substring(text, 1, prefix)
    )
    return F.sha1(key)
