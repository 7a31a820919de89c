"""State of sources and of the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import non_blank_lines, split_lines


def source_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.count("*").alias("records_in_db"))


def source_status(
    sources: DataFrame, manifest: DataFrame, counts: DataFrame, pipeline_hash: str
) -> DataFrame:
    """Adds `records_in_db`, `unchanged` and `status` to sources (source_id, source_hash, ...).

    A source is unchanged when the manifest knows it, both hashes are equal and it has rows.
    """
    known = manifest.select(
        "source_id", F.col("source_hash").alias("_hash"), F.col("pipeline_hash").alias("_pipeline")
    )
    joined = sources.join(known, "source_id", "left").join(counts, "source_id", "left")
    same_source = F.col("_hash") == F.col("source_hash")
    same_pipeline = F.col("_pipeline") == F.lit(pipeline_hash)
    rows = F.coalesce(F.col("records_in_db"), F.lit(0))
    unchanged = F.coalesce(same_source & same_pipeline, F.lit(False)) & (rows > 0)
    status = (
        F.when(F.col("_hash").isNull(), "new")
        .when(unchanged, "unchanged")
        .when(~same_source, "source_changed")
        .when(~same_pipeline, "pipeline_changed")
        .otherwise("missing_records")
    )
    return (
        joined.withColumn("records_in_db", rows)
        .withColumn("unchanged", unchanged)
        .withColumn("status", status)
        .drop("_hash", "_pipeline")
    )


def compare_counts(local: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks built now beside chunks stored, per source."""
    built = local.groupBy("source_id").agg(F.count("*").alias("local_records"))
    kept = stored.groupBy("source_id").agg(F.count("*").alias("stored_records"))
    return built.join(kept, "source_id", "full").select(
        "source_id",
        F.coalesce("local_records", F.lit(0)).alias("local_records"),
        F.coalesce("stored_records", F.lit(0)).alias("stored_records"),
    )


def domain_distribution(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("domain").agg(F.count("*").alias("n_chunks"))


def table_health(chunks: DataFrame, query_dim: int | None = None) -> DataFrame:
    """One row with counts and the list of problems of a chunk table.

    Ids are counted per key first, so distinct and duplicate ids need no exact-distinct state.
    """
    blank = F.trim(F.coalesce("chunk_id", F.lit(""))) == ""
    size = F.coalesce(F.size("embedding"), F.lit(0))
    per_id = (
        chunks.groupBy(F.when(~blank, F.col("chunk_id")).alias("_id"))
        .agg(
            F.count("*").alias("_n"),
            F.count_if(size <= 0).alias("_no_vector"),
            F.min(F.when(size > 0, size)).alias("_low"),
            F.max(F.when(size > 0, size)).alias("_high"),
        )
    )
    named = F.col("_id").isNotNull()
    totals = per_id.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count_if(named).alias("n_ids"),
        F.coalesce(F.sum(F.when(named, F.col("_n") - 1)), F.lit(0)).alias("n_duplicates"),
        F.coalesce(F.sum(F.when(~named, F.col("_n"))), F.lit(0)).alias("n_blank_ids"),
        F.coalesce(F.sum("_no_vector"), F.lit(0)).alias("n_no_embedding"),
        F.min("_low").alias("min_dim"),
        F.max("_high").alias("max_dim"),
    )
    problems = [
        F.when(F.col("n_rows") == 0, "table is empty"),
        F.when(F.col("n_blank_ids") > 0, "rows without chunk id"),
        F.when(F.col("n_duplicates") > 0, "duplicate chunk ids"),
        F.when(F.col("n_no_embedding") > 0, "rows without embedding"),
        F.when(F.col("min_dim") != F.col("max_dim"), "mixed embedding sizes"),
    ]
    if query_dim is not None:
        problems.append(F.when(F.col("max_dim") != query_dim, "query embedding size differs"))
    return totals.withColumn("problems", F.array_compact(F.array(*problems))).withColumn(
        "healthy", F.size("problems") == 0
    )


def document_profile(docs: DataFrame, lines: int) -> DataFrame:
    """Characters, lines, non-blank lines and chunks of every document."""
    # A final line break ends the last line and does not start another one.
    parts = split_lines(F.col("text"))
    n_lines = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    full = F.size(non_blank_lines(F.col("text")))
    return docs.select(
        "source_id",
        F.length("text").alias("n_chars"),
        n_lines.alias("n_lines"),
        full.alias("n_full_lines"),
        F.ceil(full / lines).cast("int").alias("n_chunks"),
    )
