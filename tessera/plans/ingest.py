"""Incremental ingest of sources into the chunk table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import IngestConfig
from tessera.operators.chunking import chunk_documents, json_documents, qna_blocks, qna_chunks
from tessera.operators.health import source_counts, source_status
from tessera.operators.topk import latest_per_key
from tessera.plans.build import complete_documents, finish_records, new_chunks_only
from tessera.sources.cut import cut
from tessera.sources.store import KeyedTable


class IngestResult(NamedTuple):
    report: DataFrame
    summary: DataFrame


def pipeline_hash(cfg: IngestConfig) -> str:
    """Fingerprint of every setting, since each can change chunks; `signature` names the ones shown to users."""
    raw = json.dumps(asdict(cfg), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(raw.encode()).hexdigest()


def text_sources(docs: DataFrame) -> DataFrame:
    """Documents (source_id, text, optional source_type/title/url/arrival) as sources, hashed by their text."""
    return complete_documents(docs).withColumns({"source_path": F.lit("text"), "source_hash": F.sha2("text", 256)})


def newest_sources(sources: DataFrame) -> DataFrame:
    """One row per source: the one of largest `arrival`, where that column is there; ties go to the larger hash."""
    repeated = sources.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1").select("source_id")
    # Where no source comes twice, no text or JSON has to be brought together.
    if cut(repeated).isEmpty():
        return sources
    newest = [F.desc_nulls_last("arrival")] if "arrival" in sources.columns else []
    return latest_per_key(sources, "source_id", [*newest, F.desc_nulls_last("source_hash")])


def incremental_ingest(
    sources: DataFrame,
    table: KeyedTable,
    manifest: KeyedTable,
    cfg: IngestConfig = IngestConfig(),
    incremental: bool = True,
    clear_source: bool = True,
    tagger=None,
    embed=None,
) -> IngestResult:
    """Brings the chunk table up to date with sources (source_id, source_path, title, source_hash, json).

    Sources of plain text have `text` in place of `json`, see `text_sources`. Of a source that comes
    several times the newest counts, see `newest_sources`. Without `clear_source` stored chunks stay,
    unless one of the same id has another text.
    """
    newest = newest_sources(sources)
    # Sources that had to be picked are read twice below, so they are picked once.
    sources = newest if newest is sources else cut(newest)

    def chunks(status: DataFrame) -> DataFrame:
        rows = changed_rows(sources, status)
        if "json" in sources.columns:
            rows = json_documents(rows.select("source_id", "title", "json"))
        rows = complete_documents(rows)
        return chunk_documents(rows.select("source_id", "source_type", "title", "url", "text"), cfg.chunks)

    return ingest_chunks(sources, chunks, table, manifest, cfg, incremental, clear_source, tagger, embed)


def ingest_qna(
    pairs: DataFrame,
    table: KeyedTable,
    manifest: KeyedTable,
    cfg: IngestConfig = IngestConfig(),
    incremental: bool = True,
    clear_source: bool = True,
    tagger=None,
    embed=None,
) -> IngestResult:
    """The same for question/answer rows (source_id, source_type, title, url, pos, question, answer).

    The hash of a source is made of sums and parities over its rows, so a source of any length is
    hashed where its rows are.
    """
    row = lambda seed: F.xxhash64(F.lit(seed), "pos", "question", "answer")
    sources = pairs.groupBy("source_id").agg(
        F.max("title").alias("title"),
        F.count("*").alias("_n"),
        F.sum(row(1).cast("decimal(20,0)")).alias("_sum"),
        F.bit_xor(row(2)).alias("_xor"),
    )
    sources = sources.select(
        "source_id",
        F.lit("qna").alias("source_path"),
        "title",
        F.sha2(F.concat_ws(":", "_n", "_sum", "_xor"), 256).alias("source_hash"),
    )

    def chunks(status: DataFrame) -> DataFrame:
        return qna_chunks(qna_blocks(changed_rows(pairs, status)), cfg.chunks)

    return ingest_chunks(sources, chunks, table, manifest, cfg, incremental, clear_source, tagger, embed)


def changed_rows(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Rows of the sources that are not `unchanged` in `status`, which has every source of the rows once.

    They are found by the shorter list of sources, which Spark can often send to the rows; where all have changed
    nothing is joined.
    """
    changed, same = (cut(status.where(c).select("source_id")) for c in (~F.col("unchanged"), F.col("unchanged")))
    left, gone = changed.count(), same.count()
    if gone > left:
        return rows.join(changed, "source_id", "left_semi")
    rows = rows.where(F.col("source_id").isNotNull())
    return rows.join(same, "source_id", "left_anti") if gone else rows


def ingest_chunks(
    sources: DataFrame,
    chunks: Callable[[DataFrame], DataFrame],
    table: KeyedTable,
    manifest: KeyedTable,
    cfg: IngestConfig = IngestConfig(),
    incremental: bool = True,
    clear_source: bool = True,
    tagger=None,
    embed=None,
) -> IngestResult:
    """Ingest of sources (source_id, source_path, title, source_hash, one row each), of which `chunks` makes chunks.

    `chunks` gets the states of all sources, see `changed_rows`. All changed ones are built in one plan. Their new rows
    are complete before anything stored is touched, and the manifest is written last: a run that
    dies is simply run again.
    """
    fingerprint = pipeline_hash(cfg)
    # Hashing reads every source once; all later steps start from these few columns.
    seen = cut(sources.select("source_id", "source_path", "title", "source_hash"))
    # Only the buckets that the incoming sources live in are read.
    stored = table.partitions_of(seen)
    status = source_status(seen, manifest.partitions_of(seen), source_counts(stored), fingerprint)
    if not incremental:
        status = status.withColumn("unchanged", F.lit(False))
    status = cut(status)
    changed = status.filter(~F.col("unchanged"))
    fresh = chunks(status.select("source_id", "unchanged"))
    if not clear_source:
        fresh = new_chunks_only(fresh, stored)
    records = cut(finish_records(fresh, cfg, tagger, embed))
    if not changed.isEmpty():
        if clear_source:
            table.replace_sources(records, changed)
        else:
            table.upsert(records)
    new = records.groupBy("source_id").agg(F.count("*").alias("new_records"))
    now = source_counts(table.partitions_of(status)).withColumnRenamed("records_in_db", "_now")
    report = cut(
        status.join(new, "source_id", "left")
        .join(now, "source_id", "left")
        .select(
            "source_id",
            "source_path",
            "source_hash",
            "status",
            F.when(F.col("unchanged"), "skipped").otherwise("ingested").alias("action"),
            F.when(F.col("unchanged"), "unchanged_source_and_pipeline").alias("reason"),
            F.when(F.col("unchanged"), 0).otherwise(F.coalesce("new_records", F.lit(0))).alias("new_records"),
            F.coalesce("_now", F.lit(0)).alias("records_in_db"),
        )
    )
    entries = report.filter(F.col("action") == "ingested").select(
        "source_id",
        "source_hash",
        F.lit(fingerprint).alias("pipeline_hash"),
        F.lit(json.dumps(cfg.signature(), sort_keys=True)).alias("pipeline_signature"),
        "source_path",
        "records_in_db",
        F.current_timestamp().alias("updated_at"),
    )
    if not entries.isEmpty():
        manifest.upsert(cut(entries))
    return IngestResult(report, ingest_summary(report))


def ingest_summary(report: DataFrame) -> DataFrame:
    """Totals of a run in one row."""
    return report.agg(
        F.count("*").alias("total_sources_seen"),
        F.count_if(F.col("action") == "ingested").alias("ingested_sources"),
        F.count_if(F.col("action") == "skipped").alias("skipped_sources"),
        F.coalesce(F.sum("new_records"), F.lit(0)).alias("total_new_records"),
        F.coalesce(F.sum("records_in_db"), F.lit(0)).alias("records_in_db"),
    )
