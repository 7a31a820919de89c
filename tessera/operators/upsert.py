"""Keyed table changes as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.topk import latest_per_key


def row_hash(columns) -> Column:
    return F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def upsert_rows(
    current: DataFrame, new: DataFrame, key: str = "chunk_id", newest: list[Column] | None = None
) -> DataFrame:
    """Current rows with the new ones put in place of equal keys; the newest copy of a key wins."""
    fresh = latest_per_key(new, key, newest) if newest else new
    fresh = fresh.select(*current.columns)
    return current.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def upsert_counts(current: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: keys inserted, keys matched, and matched rows whose content differs."""
    columns = [c for c in current.columns if c in new.columns]
    old = current.select(key, row_hash(columns).alias("_old"))
    fresh = new.select(key, row_hash(columns).alias("_new"))
    pairs = fresh.join(old, key, "left")
    return pairs.agg(
        F.count_if(F.col("_old").isNull()).alias("upserted_count"),
        F.count_if(F.col("_old").isNotNull()).alias("matched_count"),
        F.count_if(F.col("_old") != F.col("_new")).alias("modified_count"),
    )


def without_sources(current: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose source is not listed."""
    return current.join(sources.select("source_id").distinct(), "source_id", "left_anti")
