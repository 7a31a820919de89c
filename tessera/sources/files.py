"""Source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.text import title_from_stem

PREVIEW_SUFFIX = "_chunk_records_preview.json"


def json_files(spark: SparkSession, folder: str, file_name: str | None = None) -> DataFrame:
    """JSON files of a folder, or one of them, as sources; preview outputs are left out.

    Columns: source_id (file stem), source_path, title, source_hash (SHA-256 of the bytes), json.
    Spark stops with an error when the folder or file is missing.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.json")
    files = reader.load(f"{folder.rstrip('/')}/{file_name}" if file_name else folder)
    name = F.element_at(F.split("path", "/"), -1)
    if file_name is None:
        files = files.filter(~F.endswith(name, F.lit(PREVIEW_SUFFIX)))
    stem = F.regexp_replace(name, r"\.json$", "")
    return files.select(
        stem.alias("source_id"),
        F.col("path").alias("source_path"),
        title_from_stem(stem).alias("title"),
        F.sha2("content", 256).alias("source_hash"),
        F.decode("content", "UTF-8").alias("json"),
    )


def json_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of a JSON array file with a declared nested schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
