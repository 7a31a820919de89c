"""The registered queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.alignment import align
from tessera.llm.anomaly import judge_rules
from tessera.llm.common import table
from tessera.llm.jaccard import jaccard_components
from tessera.llm.licenses import scan_licenses
from tessera.llm.lines import removed_lines, text_key
from tessera.llm.media import media_columns
from tessera.llm.mixing import mix
from tessera.llm.nearest import nearest
from tessera.llm.packing import pack
from tessera.llm.quality import held_out, score, train
from tessera.llm.ranked import rank_documents
from tessera.llm.repeats import remove_repeats
from tessera.llm.urls import judge_urls

# Measured recall: 0.9997 at factor 4, 0.970 at factor 6.
NEAREST_FACTOR = 5.0
QUALITY_LIMIT = 0.3


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_weights(labels: DataFrame) -> DataFrame:
    """Sampling weights of documents: good ones count double, bad ones half, those without a label once."""
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5)
    return labels.select("doc_id", weight.alias("weight")).where("weight is not null")


def op1_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), tokenizer_path(), 2048, 0)


def op2_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, 20, NEAREST_FACTOR)


def op3_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(table(spark, sf, "documents")).drop("kept")


def op4_media(spark: SparkSession, sf: str) -> DataFrame:
    return media_columns(table(spark, sf, "documents"))


def op5_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"), quality_weights(table(spark, sf, "labels")))


def op6_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(table(spark, sf, "documents"))


def op7_urls(spark: SparkSession, sf: str) -> DataFrame:
    return judge_urls(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    gone = removed_lines(docs).select("doc_id", "text_key", F.size("removed").cast("long").alias("n"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    rows = docs.where("doc_id is not null").select("doc_id", text_key().alias("text_key"), n_lines.alias("n_lines")).join(gone, ["doc_id", "text_key"], "left")
    return rows.select("doc_id", "n_lines", F.coalesce("n", F.lit(0)).alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed_lines"))


def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_LIMIT).cast("int").alias("predicted"))


def op10_licenses(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan_licenses(table(spark, sf, "documents"))
    lists = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("sequence", "rules", "licenses")]
    return rows.select("doc_id", "n_sentences", *lists)


def op11_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 10)


def op12_align(spark: SparkSession, sf: str) -> DataFrame:
    return align(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).drop("groups")


def op13_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = judge_rules(table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    f.__name__: f
    for f in (op1_pack, op2_nearest, op3_repeats, op4_media, op5_mix, op6_jaccard, op7_urls, op8_lines, op9_quality, op10_licenses, op11_ranked, op12_align, op13_rules)
}
