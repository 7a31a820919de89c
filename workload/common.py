"""Inputs of the registered queries: the driver tables in the roles of sources and questions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DomainRules, IngestConfig, SearchConfig
from tessera.operators.postings import Postings, build_postings
from tessera.operators.tagging import entities, rule_domain
from tessera.plans.build import build_chunks
from tessera.sources.cut import cut, shared_folder, temporary_tables
from tessera.sources.payloads import text_documents
from tessera.sources.spread import spread

# The prose of the driver tables is invented, so the domain keywords are taken from it.
RULES = DomainRules(
    source=((("src1-", "src2-"), "accommodation"), (("src3-",), "sports")),
    text=(((" und ", " der "), "courses"), ((" que ",), "finance"), ((" with ", " from "), "admissions")),
)
INGEST = IngestConfig(rules=RULES)
SEARCH = SearchConfig(score_digits=6)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "documents"))
    return text_documents(rows, F.concat_ws("-", "source", "doc_id"), F.col("text"))


_written: dict = {}


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk records of all documents, written once per session as a stored table would be."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _written:
        _written[key] = cut(build_chunks(documents(spark, sf), INGEST))
    return spread(_written[key])


def postings(spark: SparkSession, sf: str) -> Postings:
    """Index of the chunk table, written once per session as an ingest would."""
    key = (spark.sparkContext.applicationId, sf, "postings")
    if key not in _written:
        chunks = chunk_table(spark, sf)
        with temporary_tables(spark):
            _written[key] = build_postings(chunks).write(f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}")
    return _written[key]


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("user_text")
    )


def plain_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Whole benchmark texts as queries without filters."""
    return questions(spark, sf).select("query_id", F.col("user_text").alias("query_text"))


def planned_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts with the domain and tags that the rules find in them."""
    text = F.col("user_text")
    return questions(spark, sf).select(
        "query_id",
        text.alias("query_text"),
        F.lit(8).alias("top_k"),
        rule_domain(F.lit(""), text, RULES).alias("domain"),
        entities(text).alias("entity_tags"),
        F.lit("Text").alias("section"),
    )


def strict_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Planned queries of which some name a domain or source that no chunk has."""
    planned = planned_queries(spark, sf)
    first = F.substring("query_text", 1, 1)
    return planned.withColumn(
        "domain", F.when(first.between("A", "I"), "nowhere").otherwise(F.col("domain"))
    ).withColumn("source_ids", F.when(first.between("E", "O"), F.array(F.lit("missing"))))


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have a label."""
    labels = table(spark, sf, "labels").select("doc_id")
    rows = spread(table(spark, sf, "documents").join(labels, "doc_id", "left_semi"))
    return text_documents(rows, F.concat_ws("-", "source", "doc_id"), F.col("text"))
