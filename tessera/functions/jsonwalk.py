"""Nested JSON text to ordered `path: value` lines, inside one row."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(document: str) -> Iterator[str]:
    todo = [("", json.loads(document))]
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict):
            start = f"{path}." if path else ""
            todo.extend([(start + key, child) for key, child in node.items()][::-1])
        elif isinstance(node, list):
            todo.extend([(f"{path}[{i}]", child) for i, child in enumerate(node)][::-1])
        elif shown := str(node).strip():
            yield f"{path}: {shown}"


def json_lines(text: Column) -> Column:
    """Array of `path: value` lines of a JSON document, in document order.

    Dict keys are joined with dots and list items are `[i]`; null reads `None` and booleans `True`
    and `False`; blank values and empty containers give no line. Text that is not JSON stops the job.

    This is an Arrow function because Spark's own JSON functions parse a document once per level and
    side (several times slower here), need a depth known in advance, sort or repeat keys, and print
    large numbers differently.
    """

    @F.pandas_udf("array<string>")
    def walk(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: None if d is None else list(_lines(d)))

    return walk(text)


def canonical_json_hash(text: Column) -> Column:
    """SHA-256 of a JSON text with sorted keys: equal content gives equal hashes."""
    return F.sha2(F.to_json(F.parse_json(text)), 256)
