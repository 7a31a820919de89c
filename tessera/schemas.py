"""Table layouts."""

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

KEY_FIELDS = T.StructType(
    [
        T.StructField("contains_price", T.BooleanType()),
        T.StructField("contains_entry_requirements", T.BooleanType()),
        T.StructField("contains_location", T.BooleanType()),
        T.StructField("contains_question_answer", T.BooleanType()),
        T.StructField("sample_price_lines", STRINGS),
        T.StructField("sample_name", T.StringType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("key_fields", KEY_FIELDS),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("confidence", T.DoubleType()),
    ]
)

CHUNK_RECORD = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("domain", T.StringType()),
        T.StructField("entity_tags", STRINGS),
        T.StructField("section", T.StringType()),
        T.StructField("order", T.IntegerType()),
        T.StructField("metadata", METADATA),
        T.StructField("version", T.StringType()),
    ]
)

PAYLOAD_COLUMNS = [f.name for f in CHUNK_RECORD if f.name != "embedding"]

QUERY = T.StructType(
    [
        T.StructField("query_text", T.StringType()),
        T.StructField("top_k", T.IntegerType()),
        T.StructField("domain", T.StringType()),
        T.StructField("domains", STRINGS),
        T.StructField("entity_tags", STRINGS),
        T.StructField("section", T.StringType()),
        T.StructField("sections", STRINGS),
        T.StructField("source_ids", STRINGS),
        T.StructField("version", T.StringType()),
        T.StructField("vector_k", T.IntegerType()),
        T.StructField("text_k", T.IntegerType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("source_hash", T.StringType()),
        T.StructField("pipeline_hash", T.StringType()),
        T.StructField("pipeline_signature", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("records_in_db", T.LongType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

SOURCE_TYPES = ("json", "pdf", "web", "txt")
