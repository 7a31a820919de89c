"""Query batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.arrays import no_strings
from tessera.schemas import QUERY


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("query_id", F.xxhash64("_file", "_at")).drop("_file", "_at")


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """Queries of JSON files that hold one object or a list of objects.

    List items that are not objects are skipped. `query_id` is a stable hash of file and position.
    """
    files = spark.read.text(path, wholetext=True).withColumn("_file", F.col("_metadata.file_path"))
    kind = F.regexp_extract(F.schema_of_variant(F.try_parse_json("value")), "^[A-Z]+", 0)
    wrong = F.raise_error(F.lit("a query file must hold a JSON object or a list")).cast("array<string>")
    items = (
        F.when(kind == "OBJECT", F.array("value"))
        .when(kind == "ARRAY", F.from_json("value", "array<string>"))
        .otherwise(wrong)
    )
    rows = files.select("_file", F.posexplode(items).alias("_at", "item"))
    is_object = F.regexp_extract(F.schema_of_variant(F.try_parse_json("item")), "^[A-Z]+", 0) == "OBJECT"
    parsed = rows.filter(is_object).select("_file", "_at", F.from_json("item", QUERY).alias("q"))
    return _numbered(parsed.select("_file", "_at", "q.*"))


def query_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Queries from a column with one JSON object per row; anything else stops the job."""
    kind = F.regexp_extract(F.schema_of_variant(F.try_parse_json(column)), "^[A-Z]+", 0)
    wrong = F.raise_error(F.lit("a query must be a JSON object")).cast("string")
    checked = F.when(kind == "OBJECT", F.col(column)).otherwise(wrong)
    keep = [c for c in rows.columns if c != column]
    return rows.select(*keep, F.from_json(checked, QUERY).alias("q")).select(*keep, "q.*")


def query_texts(
    rows: DataFrame,
    query_id: Column,
    text: Column,
    top_k: int = 6,
    domains=(),
    entity_tags=(),
    sections=(),
    source_ids=(),
    version: str | None = None,
    vector_k: int | None = None,
    text_k: int | None = None,
) -> DataFrame:
    """Plain texts that share the same filters and sizes."""

    def fixed(values) -> Column:
        return F.array(*[F.lit(v) for v in values]) if values else no_strings()

    none = F.lit(None).cast("string")
    return rows.select(
        query_id.cast("bigint").alias("query_id"),
        text.alias("query_text"),
        F.lit(top_k).alias("top_k"),
        none.alias("domain"),
        fixed(domains).alias("domains"),
        fixed(entity_tags).alias("entity_tags"),
        none.alias("section"),
        fixed(sections).alias("sections"),
        fixed(source_ids).alias("source_ids"),
        F.lit(version).cast("string").alias("version"),
        F.lit(vector_k).cast("int").alias("vector_k"),
        F.lit(text_k).cast("int").alias("text_k"),
    )
