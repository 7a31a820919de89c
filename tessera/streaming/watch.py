"""Ingest driven by arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.config import IngestConfig
from tessera.functions.text import title_from_stem
from tessera.plans.ingest import incremental_ingest
from tessera.sources.files import PREVIEW_SUFFIX
from tessera.sources.store import KeyedTable


def arriving_json(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of new JSON files as sources."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.json")
        .load(folder)
    )
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.json$", "")
    return files.filter(~F.endswith(name, F.lit(PREVIEW_SUFFIX))).select(
        stem.alias("source_id"),
        F.col("path").alias("source_path"),
        title_from_stem(stem).alias("title"),
        F.sha2("content", 256).alias("source_hash"),
        F.decode("content", "UTF-8").alias("json"),
    )


def watch_folder(
    spark: SparkSession,
    folder: str,
    table: KeyedTable,
    manifest: KeyedTable,
    checkpoint: str,
    cfg: IngestConfig = IngestConfig(),
    **trigger,
) -> StreamingQuery:
    """Starts a query that ingests every micro-batch of new files.

    A repeated micro-batch changes nothing, because the manifest already has its hashes.
    """

    def step(batch: DataFrame, _: int) -> None:
        incremental_ingest(batch, table, manifest, cfg)

    return (
        arriving_json(spark, folder)
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
