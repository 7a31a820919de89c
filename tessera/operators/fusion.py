"""Merging two ranked lists per query into one scored list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import TOP_K_RANGE, FusionWeights
from tessera.functions.arrays import lower_set
from tessera.functions.text import strip
from tessera.operators.topk import top_k

CHANNELS = ("vector", "text")


def rank_unit(rank: Column, total: Column) -> Column:
    """1 for the first rank, 0 for the last, 1 when there is only one."""
    return F.when(total <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (rank - 1) / (total - 1)))


def score_unit(score: Column, low: Column, high: Column, fallback: Column) -> Column:
    """Min-max scaling; 1 when all scores are equal, the fallback when the score is missing."""
    return (
        F.when(score.isNull(), fallback)
        .when(high <= low, F.lit(1.0))
        .otherwise((score - low) / (high - low))
    )


def stack_channels(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """Both hit lists as one table with a `channel` column."""
    return vector_hits.withColumn("channel", F.lit("vector")).unionByName(
        text_hits.withColumn("channel", F.lit("text")), allowMissingColumns=True
    )


def merge_hits(hits: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """One row per query and chunk with ranks, scores, totals and bounds of both channels.

    Totals and score bounds count every hit; rows with a blank chunk id are dropped after that.
    A chunk seen twice in a channel keeps its best rank and its last score. With `payload`
    columns (text among them) the longest text supplies them, the earliest seen on a tie.
    """
    channel = Window.partitionBy("query_id", "channel")
    sized = (
        hits.withColumn("_total", F.count("*").over(channel))
        .withColumn("_low", F.min("score").over(channel))
        .withColumn("_high", F.max("score").over(channel))
        .withColumn("chunk_id", strip(F.coalesce(F.col("chunk_id"), F.lit(""))))
        .filter(F.col("chunk_id") != "")
    )
    values = []
    for name in CHANNELS:
        mine = F.col("channel") == name
        rank = F.when(mine, F.col("rank"))
        values += [
            F.min(rank).alias(f"{name}_rank"),
            F.max_by(F.when(mine, F.col("score")), rank).alias(f"{name}_score"),
            F.max(F.when(mine, F.col("_total"))).alias(f"{name}_total"),
            F.max(F.when(mine, F.col("_low"))).alias(f"{name}_low"),
            F.max(F.when(mine, F.col("_high"))).alias(f"{name}_high"),
        ]
    if payload:
        later = F.when(F.col("channel") == "text", 1).otherwise(0)
        richness = F.struct(F.length(F.coalesce("text", F.lit(""))), -later, -F.col("rank"))
        values.append(F.max_by(F.struct(*payload), richness).alias("_payload"))
    merged = sized.groupBy("query_id", "chunk_id").agg(*values)
    if payload:
        merged = merged.select("*", "_payload.*").drop("_payload")
    return merged


def channel_part(name: str, weight: float, share: float) -> Column:
    rank, total = F.col(f"{name}_rank"), F.col(f"{name}_total")
    placed = rank_unit(rank, total)
    scaled = score_unit(F.col(f"{name}_score"), F.col(f"{name}_low"), F.col(f"{name}_high"), placed)
    return F.when(rank.isNull(), 0.0).otherwise(F.lit(weight) * (share * placed + (1 - share) * scaled))


def boost_sets(queries: DataFrame) -> DataFrame:
    """Adds the lower-cased sets `boost_sections` and `boost_tags`."""
    return queries.withColumn(
        "boost_sections", lower_set(F.array("section"), F.col("sections"))
    ).withColumn("boost_tags", lower_set(F.col("entity_tags")))


def tag_overlap(chunk_tags: Column, query_tags: Column) -> Column:
    """Number of tags shared without regard to case."""
    return F.size(F.array_intersect(lower_set(chunk_tags), lower_set(query_tags)))


def fused_score(weights: FusionWeights, digits: int) -> Column:
    """Channel parts plus boosts, over the columns of merge_hits and boost_sets."""
    w = weights.normalised()
    both = F.col("vector_rank").isNotNull() & F.col("text_rank").isNotNull()
    section = F.lower(F.coalesce(F.col("section"), F.lit("")))
    in_section = (section != "") & F.array_contains("boost_sections", section)
    shared = tag_overlap(F.col("entity_tags"), F.col("boost_tags"))
    score = (
        channel_part("vector", w.vector, w.rank_share)
        + channel_part("text", w.text, w.rank_share)
        + F.when(both, w.overlap).otherwise(0.0)
        + F.when(in_section, w.section).otherwise(0.0)
        + F.least(F.lit(w.tag) * shared, F.lit(w.tag * w.tag_cap))
    )
    return F.round(score, digits)


def rank_candidates(
    merged: DataFrame, queries: DataFrame, weights: FusionWeights, digits: int = 9
) -> DataFrame:
    """Scores merged candidates and keeps each query's `top_k` best with their rank.

    Equal scores keep the order vector rank, then text rank.
    """
    boosts = boost_sets(queries).select("query_id", "top_k", "boost_sections", "boost_tags")
    scored = merged.join(boosts, "query_id").withColumn("final", fused_score(weights, digits))
    order = [
        F.desc("final"),
        F.asc_nulls_last("vector_rank"),
        F.asc_nulls_last("text_rank"),
        F.col("chunk_id"),
    ]
    best = top_k(scored, ["query_id"], order, limit=TOP_K_RANGE[1], k="top_k")
    channels = F.filter(
        F.array(
            F.when(F.col("vector_rank").isNotNull(), "vector"),
            F.when(F.col("text_rank").isNotNull(), "text"),
        ),
        lambda c: c.isNotNull(),
    )
    return best.withColumn("retrieval_channels", channels).withColumnRenamed("final", "score")


def fuse_hits(
    vector_hits: DataFrame,
    text_hits: DataFrame,
    queries: DataFrame,
    weights: FusionWeights = FusionWeights(),
    digits: int = 9,
) -> DataFrame:
    """Fuses two hit tables that carry their own text, section and entity_tags."""
    known = {"query_id", "chunk_id", "score", "rank"}
    payload = [c for c in vector_hits.columns if c not in known]
    merged = merge_hits(stack_channels(vector_hits, text_hits), payload)
    return rank_candidates(merged, queries, weights, digits)
