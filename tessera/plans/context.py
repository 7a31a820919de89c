"""Evidence to the context and prompt of an answering model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_CHUNKS = 20


def build_context(evidence: DataFrame, k: int = DEFAULT_CHUNKS) -> DataFrame:
    """Texts of the k best chunks per query, joined with blanks in rank order.

    A group holds at most k rows, because evidence is already ranked.
    """
    best = evidence.filter(F.col("rank") <= k)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "text")))
    return best.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["text"]), " ").alias("context"),
        F.count("*").alias("n_chunks"),
    )


ANSWER_TASK = "Reply to the question with what the passages say. Where they are silent, say that you do not know."


def answer_prompts(contexts: DataFrame, queries: DataFrame, task: str = ANSWER_TASK) -> DataFrame:
    """Adds `prompt`: the task, then the passages, then the question."""
    prompt = F.concat_ws("\n\n", F.lit(task), F.concat(F.lit("Passages: "), F.col("context")), F.concat(F.lit("Question: "), F.col("query_text")))
    return contexts.join(queries.select("query_id", "query_text"), "query_id").withColumn("prompt", prompt)
