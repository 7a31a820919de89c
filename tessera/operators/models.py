"""Hooks for user models: embedders and taggers run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clean
from tessera.functions.vectors import hash_embedding, is_embedded


def model_embedding(make_model: Callable[[], Callable], batch: int = 64):
    """Column function text -> vector for a user embedder.

    `make_model` is called once per task and returns a function list[str] -> list of vectors.
    """

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for texts in parts:
            vectors = []
            for at in range(0, len(texts), batch):
                wanted = list(texts.iloc[at : at + batch])
                got = list(model(wanted))
                if len(got) != len(wanted):
                    raise ValueError(f"embedder gave {len(got)} vectors for {len(wanted)} texts")
                if any(len(v) == 0 for v in got):
                    raise ValueError("embedder gave an empty vector")
                vectors.extend([float(x) for x in v] for v in got)
            yield pd.Series(vectors)

    embed = embed.asNondeterministic()
    return lambda text: embed(clean(text))


def model_answer(make_model: Callable[[], Callable], stop: bool = False):
    """Column function prompt -> answer text for a user model.

    A failed call gives null, which suits a tagger that has rules to fall back on; with `stop`, as
    for a planner, it stops the job.
    """

    @F.pandas_udf("string")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()

        def one(prompt):
            try:
                return model(prompt)
            except Exception:
                if stop:
                    raise
                return None

        for prompts in parts:
            yield prompts.map(one)

    return ask.asNondeterministic()


def with_embedding(
    df: DataFrame, text: str = "text", dim: int = 64, embed: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Adds `embedding`; the default is the hash vector. A blank text stops the job."""
    vector = embed(F.col(text)) if embed else hash_embedding(F.col(text), dim)
    failed = F.raise_error(F.lit("a chunk has no embedding")).cast("array<double>")
    return df.withColumn("embedding", vector).withColumn(
        "embedding", F.when(is_embedded(F.col("embedding")), F.col("embedding")).otherwise(failed)
    )


def dimension_profile(chunks: DataFrame, query_dim: int | None = None) -> DataFrame:
    """Stored vector sizes with their counts, and whether they fit the query embedder."""
    sizes = chunks.groupBy(F.coalesce(F.size("embedding"), F.lit(0)).alias("dim")).agg(
        F.count("*").alias("n")
    )
    if query_dim is None:
        return sizes
    return sizes.withColumn("matches_query", F.col("dim") == query_dim)
