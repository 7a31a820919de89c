"""Mixing sources to target weights by weighted sampling with exponential keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents_of, word_count
from tessera.sources.cut import cut

ROWS_PER_BUCKET = 2_000


def source_targets(totals: DataFrame, weights: tuple[float, ...], budget: float, most_epochs: float) -> DataFrame:
    """`source_key`, `source_size` and `target` of each source; `totals` has one row per source.

    Sources in code point order, null last, take the weights in turn and share `budget` times all sizes. A target
    stops at `most_epochs` times its source's size; what is over goes to the others by weight. Sorted by the level
    at which a source is full, the full ones are a prefix, so one pass finds the common level of the rest.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("most", F.lit(float(most_epochs)) * F.col("source_size"))
    rows = rows.withColumn("full_at", F.col("most") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before, rest, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    rows = rows.withColumn("level", (F.lit(float(budget)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    rows = rows.withColumn("full", F.col("most") <= F.col("level") * F.col("weight")).withColumn("place", F.row_number().over(by_level))
    common = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(whole)["level"]
    return rows.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(common * F.col("weight"))).select("source_key", "source_size", "target")


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most_epochs: float = 2, seed: str = "mix", also: tuple[str, ...] = ()) -> DataFrame:
    """Words that a mix takes of every document: `doc_id, size, source_size, target, taken`, and the columns `also`.

    A source's words are taken in whole epochs first; the rest of its target goes to documents in the order of
    their keys -ln(u) / quality until the prefix sum of sizes reaches it, so only the last one is taken in part.
    `u` comes from the document's id, so reruns agree. `quality` is a table of `doc_id` and `weight`;
    documents that it does not name, or gives no weight above 0, weigh 1. A hot source is sorted in buckets of its keys, not in one task.

    A null text has size 0; a null source is a source of its own, the last one; rows without a doc_id are left out.
    Repeated rows are documents of their own. An empty table gives no rows. Other columns are not read.
    """
    rows = documents_of(docs, "source", *also).select("doc_id", "source", *also, word_count(F.col("text")).alias("size"))
    if quality is not None:
        of = quality.where("doc_id is not null and weight > 0 and weight < double('inf')").groupBy("doc_id").agg(F.max("weight").cast("double").alias("weight"))
        rows = rows.join(of, "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(None).cast("double"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = cut(
        rows.select(
            "doc_id",
            "size",
            "source",
            *also,
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"),
            (-F.ln(u) / F.coalesce("weight", F.lit(1.0))).alias("key"),
        )
    )
    totals = rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    totals = cut(totals)
    buckets = totals.select("source_key", F.ceil(F.col("n") / ROWS_PER_BUCKET).alias("buckets"))
    rows = rows.join(buckets, "source_key").withColumn(
        "bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1)
    )
    sums = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("in_bucket"))
    until = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_key", "bucket", F.coalesce(F.sum("in_bucket").over(until), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("source_key", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(sums, ["source_key", "bucket"]).join(source_targets(totals, weights, budget, most_epochs), "source_key")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size") - F.col("earlier") - F.col("before")
    return rows.withColumn("epochs", epochs).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))).cast("long").alias("taken"),
        *also,
    )
