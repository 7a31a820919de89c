"""Hybrid search for a table of queries."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import CHANNEL_K_RANGE, TOP_K_RANGE, SearchConfig
from tessera.functions.arrays import as_list, no_strings, strings, unique
from tessera.functions.text import clean
from tessera.functions.vectors import clamp, hash_embedding
from tessera.operators.fusion import boost_sets, merge_hits, rank_candidates, stack_channels
from tessera.operators.lexical import lexical_hits
from tessera.operators.postings import Postings
from tessera.operators.vector_search import Cells, cell_vector_hits, exact_vector_hits
from tessera.sources.cut import cut
from tessera.schemas import PAYLOAD_COLUMNS, QUERY
from tessera.sources.store import KeyedTable


class SearchResult(NamedTuple):
    evidence: DataFrame
    diagnostics: DataFrame


def candidate_sizes(queries: DataFrame) -> DataFrame:
    """Clamps top_k and fills vector_k, text_k and the approximate pool size."""
    usual = F.greatest(F.lit(20), 4 * F.col("top_k"))
    sized = (
        queries.withColumn("top_k", clamp(F.coalesce("top_k", F.lit(8)), *TOP_K_RANGE))
        .withColumn("vector_k", clamp(F.coalesce("vector_k", usual), *CHANNEL_K_RANGE))
        .withColumn("text_k", clamp(F.coalesce("text_k", usual), *CHANNEL_K_RANGE))
    )
    return sized.withColumn("vector_pool", F.greatest(5 * F.col("vector_k"), F.col("vector_k") + 10))


def checked_sizes(queries: DataFrame) -> DataFrame:
    """Stops the job when a query asks for more or fewer rows than is legal; a missing size is filled in later."""
    for name, (low, high) in (("top_k", TOP_K_RANGE), ("vector_k", CHANNEL_K_RANGE), ("text_k", CHANNEL_K_RANGE)):
        wrong = F.raise_error(F.concat(F.lit(f"{name} must be between {low} and {high}: "), F.col(name).cast("string")))
        legal = F.col(name).isNull() | F.col(name).between(low, high)
        queries = queries.withColumn(name, F.when(legal, F.col(name)).otherwise(wrong.cast("int")))
    return queries


def filter_lists(queries: DataFrame) -> DataFrame:
    """Adds the cleaned constraint lists; an empty list constrains nothing."""
    return (
        queries.withColumn(
            "domains", unique(F.concat(as_list(F.col("domain")), F.coalesce("domains", no_strings())), True)
        )
        .withColumn("source_ids", unique(F.col("source_ids")))
        .withColumn("versions", F.when(F.col("version") != "", F.array("version")).otherwise(no_strings()))
    )


def complete_queries(queries: DataFrame) -> DataFrame:
    """Adds missing optional query columns as nulls and cleans the text."""
    for field in QUERY:
        if field.name not in queries.columns:
            queries = queries.withColumn(field.name, F.lit(None).cast(field.dataType))
    return queries.withColumn("query_text", clean(F.col("query_text")))


def prepare_queries(queries: DataFrame, cfg: SearchConfig, embed=None) -> DataFrame:
    """Queries ready for both channels; blank ones are left out, sizes out of range stop the job."""
    ready = filter_lists(candidate_sizes(checked_sizes(complete_queries(queries)))).filter(F.col("query_text") != "")
    vector = embed(F.col("query_text")) if embed else hash_embedding(F.col("query_text"), cfg.embedding_dim)
    return ready if "vector" in ready.columns else ready.withColumn("vector", vector)


def metadata_filter(chunks: DataFrame, domains=(), source_ids=(), version=None) -> DataFrame:
    """The filter of one query as plain predicates, which reach the Parquet scan."""
    domains = list(dict.fromkeys(d.strip().lower() for d in domains if d and d.strip()))
    source_ids = list(dict.fromkeys(s.strip() for s in source_ids if s and s.strip()))
    if domains:
        chunks = chunks.filter(F.col("domain").isin(domains))
    if source_ids:
        chunks = chunks.filter(F.col("source_id").isin(source_ids))
    if version:
        chunks = chunks.filter(F.col("version") == version)
    return chunks


def vector_hits(chunks, prepared, cfg: SearchConfig, cells: Cells | None = None) -> DataFrame:
    asked = prepared.select(
        "query_id", F.col("vector_k").alias("k"), "vector_pool", "domains", "source_ids", "versions", "vector"
    )
    if cfg.vector_mode == "exact":
        return exact_vector_hits(chunks, asked, cfg)
    if cells is None or "cell" not in chunks.columns:
        raise ValueError("vector_mode 'ivf' needs trained cells and chunks with a 'cell' column")
    return cell_vector_hits(chunks, asked, cells, cfg)


def text_hits(chunks, prepared, cfg: SearchConfig, index: Postings | None = None) -> DataFrame:
    asked = prepared.select(
        "query_id", F.col("text_k").alias("k"), "domains", "source_ids", "versions", "query_text"
    )
    return lexical_hits(chunks, asked, cfg, index)


def rows_of(chunks: DataFrame | KeyedTable, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    return with_text(chunks.read() if isinstance(chunks, KeyedTable) else chunks, cfg.text_field)


def with_text(chunks: DataFrame, field: str) -> DataFrame:
    """Chunks whose `text` is the column named; without such a column it is empty."""
    if field == "text":
        return chunks
    named = F.coalesce(F.col(field).cast("string"), F.lit("")) if field in chunks.columns else F.lit("")
    return chunks.withColumn("text", named)


def hybrid_search(
    chunks: DataFrame | KeyedTable,
    queries: DataFrame,
    cfg: SearchConfig = SearchConfig(),
    index: Postings | None = None,
    cells: Cells | None = None,
    embed=None,
) -> SearchResult:
    """Ranked evidence and per-query diagnostics.

    `chunks` has unique chunk ids. Given as a stored table, the payload of the candidates is read from
    the partitions of their sources only. Both channels read narrow columns only and
    their few hits are written before they are merged: each channel runs once, and the join that
    fetches text and metadata of the candidates is planned with their true size.
    """
    table = chunks if isinstance(chunks, KeyedTable) else None
    chunks = rows_of(chunks, cfg)
    prepared = cut(prepare_queries(queries, cfg, embed))
    near = vector_hits(chunks, prepared, cfg, cells)
    said = text_hits(chunks, prepared, cfg, index)
    hits = cut(stack_channels(near, said))
    candidates = merge_hits(hits)
    payload = (with_text(table.partitions_of(hits), cfg.text_field) if table else chunks).select(*PAYLOAD_COLUMNS)
    found = rank_candidates(candidates.join(payload, "chunk_id"), prepared, cfg.weights, cfg.score_digits)
    evidence = evidence_rows(found)
    return SearchResult(evidence, query_diagnostics(queries, prepared, hits, evidence, cfg))


def evidence_rows(found: DataFrame) -> DataFrame:
    """Result rows with defaults for missing values."""
    return found.select(
        "query_id",
        F.col("rank").cast("int").alias("rank"),
        "chunk_id",
        F.coalesce("source_id", F.lit("")).alias("source_id"),
        "source_type",
        "title",
        "url",
        F.coalesce("text", F.lit("")).alias("text"),
        "domain",
        strings(F.col("entity_tags")).alias("entity_tags"),
        "section",
        F.coalesce(F.col("order"), F.lit(0)).alias("order"),
        "version",
        "score",
        "vector_score",
        "text_score",
        "retrieval_channels",
        "metadata",
    )


def query_diagnostics(
    queries: DataFrame, prepared: DataFrame, hits: DataFrame, evidence: DataFrame, cfg: SearchConfig
) -> DataFrame:
    """Hit counts, modes and boost sets per query, blank queries included."""
    text_mode = (
        F.max(F.when(F.col("channel") == "text", F.col("mode"))) if "mode" in hits.columns else F.lit(None)
    )
    counted = hits.groupBy("query_id").agg(
        F.count_if(F.col("channel") == "vector").alias("vector_hits"),
        F.count_if(F.col("channel") == "text").alias("text_hits"),
        text_mode.alias("text_mode"),
    )
    final = evidence.groupBy("query_id").agg(F.count("*").alias("final_hits"))
    boosts = boost_sets(prepared).select(
        "query_id",
        "top_k",
        F.array_sort("boost_sections").alias("boost_sections"),
        F.array_sort("boost_tags").alias("boost_entity_tags"),
    )
    last = "bm25" if cfg.text_mode == "bm25" else "scan"
    return (
        queries.select("query_id", clean(F.col("query_text")).alias("query_text"))
        .join(boosts, "query_id", "left")
        .join(counted, "query_id", "left")
        .join(final, "query_id", "left")
        .select(
            "query_id",
            "query_text",
            "top_k",
            F.lit(cfg.vector_mode).alias("vector_mode"),
            F.coalesce("text_mode", F.lit(last)).alias("text_mode"),
            (F.coalesce("text_mode", F.lit(last)) == "scan").alias("text_fallback_used"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("vector_hits", "text_hits", "final_hits")],
            "boost_sections",
            "boost_entity_tags",
            (F.col("query_text") == "").alias("blank_query"),
        )
    )
