"""Ranking inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import CHANNEL_K_RANGE

# Below this many shuffle partitions one merge task per group sees few candidates anyway.
TWO_STEP_FROM = 64
FAN_IN = 64


def ranked(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    limit: int = CHANNEL_K_RANGE[1],
    k: str | None = None,
    rank: str = "rank",
) -> DataFrame:
    """First rows of every group with their rank.

    The constant `limit` lets Spark cut each map partition before the shuffle; the column `k`
    then applies the group's own size; one above `limit` stops the job. On clusters with many partitions the survivors of a
    group are first merged by subsets of map partitions, so one task never receives the
    candidates of every partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if parts >= TWO_STEP_FROM:
        lane = df.withColumn("_lane", F.spark_partition_id() % FAN_IN)
        df = ranked(lane, [*by, "_lane"], order, "_lane_rank").filter(F.col("_lane_rank") <= limit)
        df = df.drop("_lane", "_lane_rank")
    kept = ranked(df, by, order, rank).filter(F.col(rank) <= limit)
    if k is None:
        return kept
    over = F.raise_error(F.concat(F.lit(f"more than {limit} rows are asked for: "), F.col(k).cast("string"))).cast("boolean")
    return kept.filter(F.when(F.col(k) > limit, over).otherwise(F.col(rank) <= F.col(k)))


def latest_per_key(df: DataFrame, key: str, newest: list[Column]) -> DataFrame:
    """One row per key, the newest, with one shuffle: each map partition keeps one row of a key before it."""
    return ranked(df, [key], newest, "_newest").filter(F.col("_newest") == 1).drop("_newest")
