"""Retrying queries that found nothing with fewer constraints."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import SearchConfig
from tessera.functions.arrays import no_strings
from tessera.operators.lexical import index_for
from tessera.plans.search import complete_queries, hybrid_search, rows_of
from tessera.sources.cut import cut
from tessera.sources.store import KeyedTable


class RelaxedResult(NamedTuple):
    evidence: DataFrame
    attempts: DataFrame
    diagnostics: DataFrame
    outcome: DataFrame


def without_domains(queries: DataFrame) -> DataFrame:
    """Same plan, no domain filter; other filters and boosts stay."""
    return queries.withColumn("domain", F.lit(None).cast("string")).withColumn("domains", no_strings())


def bare(queries: DataFrame) -> DataFrame:
    """The raw user text with the planned top_k, nothing else."""
    raw = "user_text" if "user_text" in queries.columns else "query_text"
    return complete_queries(queries.select("query_id", F.col(raw).alias("query_text"), "top_k"))


ATTEMPTS = (
    (1, "full_plan", lambda q: q),
    (2, "relax_domain", without_domains),
    (3, "bare_query", bare),
)


def search_with_relaxation(
    chunks: DataFrame | KeyedTable, queries: DataFrame, cfg: SearchConfig = SearchConfig(), **search
) -> RelaxedResult:
    """Searches in up to three attempts; each later one runs only for unanswered queries.

    The evidence of an attempt is written before the next one, so no attempt is computed twice.
    """
    full = complete_queries(queries)
    waiting = full
    if cfg.text_mode != "scan" and search.get("index") is None:
        # Term statistics do not depend on filters, so all attempts can share them.
        texts = full.select("query_text").unionByName(bare(full).select("query_text"))
        search["index"] = index_for(rows_of(chunks, cfg), texts)
    evidence, attempts, diagnostics = [], [], []
    for number, name, relax in ATTEMPTS:
        found = hybrid_search(chunks, relax(waiting), cfg, **search)
        rows = cut(found.evidence.withColumn("attempt", F.lit(number)))
        hits = rows.groupBy("query_id").agg(F.count("*").alias("hits"))
        log = waiting.select("query_id").join(hits, "query_id", "left")
        attempts.append(
            log.select(
                "query_id",
                F.lit(number).alias("attempt"),
                F.lit(name).alias("description"),
                F.coalesce("hits", F.lit(0)).alias("hits"),
            )
        )
        evidence.append(rows)
        diagnostics.append(found.diagnostics.withColumn("attempt", F.lit(number)))
        left = cut(waiting.join(rows.select("query_id").distinct(), "query_id", "left_anti"))
        waiting = left
        if left.isEmpty():
            break
    all_attempts = cut(reduce(DataFrame.unionByName, attempts))
    last = all_attempts.groupBy("query_id").agg(F.max("attempt").alias("attempt"))
    outcome = all_attempts.groupBy("query_id").agg(
        F.min(F.when(F.col("hits") > 0, F.col("attempt"))).alias("attempt_used"),
        F.sum("hits").alias("result_count"),
    )
    return RelaxedResult(
        reduce(DataFrame.unionByName, evidence),
        all_attempts,
        reduce(DataFrame.unionByName, diagnostics).join(last, ["query_id", "attempt"]),
        outcome,
    )
