"""Report outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_previews(chunks: DataFrame, path: str) -> None:
    """Chunk records as JSON, one folder per source, for a look at a few sources."""
    chunks.withColumn("source", F.col("source_id")).write.mode("overwrite").partitionBy("source").json(path)


def evidence_report(queries: DataFrame, diagnostics: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per query: the query, its diagnostics, result count and nested evidence.

    A query has at most the largest legal `top_k` evidence rows, so the nested list is bounded.
    """
    columns = [c for c in evidence.columns if c not in ("query_id", "rank")]
    rows = evidence.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *columns)), lambda a, b: a["rank"] - b["rank"]).alias("_rows")
    )
    query = F.struct(*[c for c in queries.columns if c != "query_id"]).alias("query")
    diagnostic = F.struct(*[c for c in diagnostics.columns if c != "query_id"])
    return (
        queries.select("query_id", query)
        .join(diagnostics.select("query_id", diagnostic.alias("diagnostics")), "query_id", "left")
        .join(rows, "query_id", "left")
        .select(
            "query_id",
            "query",
            "diagnostics",
            F.coalesce(F.size("_rows"), F.lit(0)).alias("result_count"),
            F.col("_rows").alias("evidence"),
        )
    )


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
