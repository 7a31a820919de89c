"""Sources that are tables already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.jsonwalk import canonical_json_hash


def json_payloads(payloads: DataFrame) -> DataFrame:
    """(source_id, json, optional title and arrival) to sources; the hash ignores key order."""
    if "title" not in payloads.columns:
        payloads = payloads.withColumn("title", F.lit(None).cast("string"))
    return payloads.select(
        "source_id",
        F.lit("payload").alias("source_path"),
        "title",
        canonical_json_hash(F.col("json")).alias("source_hash"),
        "json",
        *(["arrival"] if "arrival" in payloads.columns else []),
    )


def text_documents(
    df: DataFrame, source_id: Column, text: Column, title: Column | None = None, url: Column | None = None
) -> DataFrame:
    """Plain-text documents of any table."""
    none = F.lit(None).cast("string")
    return df.select(
        source_id.cast("string").alias("source_id"),
        F.lit("txt").alias("source_type"),
        (none if title is None else title).alias("title"),
        (none if url is None else url).alias("url"),
        F.coalesce(text, F.lit("")).alias("text"),
    )


def qna_pairs(turns: DataFrame) -> DataFrame:
    """Conversation turns (conv_id, turn, role, text) to question/answer rows.

    A user turn is a question; the turn after it is the answer when the assistant gave it.
    The self-join is on the unique (conversation, turn) key, so a long conversation is spread.
    """
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("pos"), F.col("text").alias("question")
    )
    replies = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("pos"), F.col("text").alias("answer")
    )
    return asked.join(replies, ["conv_id", "pos"], "left").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("source_id"),
        F.lit("web").alias("source_type"),
        F.lit("Web Q&A").alias("title"),
        F.lit(None).cast("string").alias("url"),
        "pos",
        "question",
        "answer",
    )
