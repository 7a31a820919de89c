"""Documents to finished chunk records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import IngestConfig
from tessera.operators.chunking import chunk_documents
from tessera.operators.models import with_embedding
from tessera.operators.tagging import merge_model_tags, tag_prompts, with_rule_tags
from tessera.schemas import CHUNK_RECORD


def complete_documents(docs: DataFrame) -> DataFrame:
    """Adds the optional document columns as nulls where they are missing."""
    for name in ("title", "url"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("string"))
    if "source_type" not in docs.columns:
        docs = docs.withColumn("source_type", F.lit("txt"))
    return docs


def new_chunks_only(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks that are not stored yet with this id and this text; runs before any model is asked.

    An id is made of the first characters of a chunk only, so one edited behind them counts as new.
    """
    known = stored.select("chunk_id", F.sha2("text", 256).alias("_text"))
    hashed = chunks.withColumn("_text", F.sha2("text", 256))
    return hashed.join(known, ["chunk_id", "_text"], "left_anti").select(*chunks.columns)


def finish_records(
    chunks: DataFrame,
    cfg: IngestConfig = IngestConfig(),
    tagger: Callable[[Column], Column] | None = None,
    embed: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Chunks to stored records: tags, vector, metadata, version."""
    tagged = with_rule_tags(complete_documents(chunks), cfg.rules)
    if tagger is not None:
        asked = tag_prompts(tagged).withColumn("_answer", tagger(F.col("prompt"))).drop("prompt", "system_prompt")
        tagged = merge_model_tags(asked, "_answer")
    ready = with_embedding(tagged, "text", cfg.embedding_dim, embed)
    metadata = F.struct("key_fields", "extra", "confidence")
    return ready.withColumn("metadata", metadata).withColumn("version", F.lit(cfg.version)).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNK_RECORD]
    )


def build_chunks(
    docs: DataFrame,
    cfg: IngestConfig = IngestConfig(),
    existing: DataFrame | None = None,
    tagger: Callable[[Column], Column] | None = None,
    embed: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Documents (source_id, text, optional source_type/title/url) to chunk records.

    With `existing` the stored chunks are left out before tagging and embedding.
    """
    chunks = chunk_documents(complete_documents(docs), cfg.chunks)
    if existing is not None:
        chunks = new_chunks_only(chunks, existing)
    return finish_records(chunks, cfg, tagger, embed)
