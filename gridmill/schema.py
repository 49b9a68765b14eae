"""Fixed physical schemas of the fact store."""

from __future__ import annotations

from pyspark.sql import types as T

NUMBER = T.DecimalType(38, 10)
FACT_COLUMNS = ("document_id", "table_id", "table_index", "row_index", "col_index", "page_number", "column_name", "column_key", "row_label", "value_text", "value_num", "value_date", "unit", "scale_factor", "value_type", "parse_note")

DOCUMENTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("filename", T.StringType(), False),
    T.StructField("file_hash", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("page_count", T.IntegerType()),
    T.StructField("table_count", T.IntegerType()),
    T.StructField("chunk_count", T.IntegerType()),
    T.StructField("fact_count", T.IntegerType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("markdown_path", T.StringType()),
    T.StructField("uploaded_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

#: Document states, in the order of a successful run, then the failed one.
STATUSES = ("pending", "extracting", "parsing_tables", "chunking", "completed", "failed")

FACTS = T.StructType([
    T.StructField("document_id", T.StringType()),
    T.StructField("table_id", T.StringType(), False),
    T.StructField("table_index", T.IntegerType()),
    T.StructField("row_index", T.IntegerType(), False),
    T.StructField("col_index", T.IntegerType(), False),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("column_key", T.StringType(), False),
    T.StructField("row_label", T.StringType()),
    T.StructField("value_text", T.StringType()),
    T.StructField("value_num", NUMBER),
    T.StructField("value_date", T.DateType()),
    T.StructField("unit", T.StringType()),
    T.StructField("scale_factor", NUMBER),
    T.StructField("value_type", T.StringType(), False),
    T.StructField("parse_note", T.StringType()),
])

REGISTRY = T.StructType([
    T.StructField("table_id", T.StringType(), False),
    T.StructField("document_id", T.StringType()),
    T.StructField("table_index", T.IntegerType()),
    T.StructField("original_filename", T.StringType()),
    T.StructField("semantic_description", T.StringType()),
    T.StructField("headers", T.ArrayType(T.StringType())),
    T.StructField("column_keys", T.ArrayType(T.StringType())),
    T.StructField("column_profiles", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("scale", T.StringType()),
        T.StructField("numeric_coverage", T.DoubleType()),
        T.StructField("distinct", T.LongType()),
        T.StructField("is_label", T.BooleanType()),
    ]))),
    T.StructField("label_column_key", T.StringType()),
    T.StructField("row_count", T.IntegerType()),
    T.StructField("fact_count", T.IntegerType()),
    T.StructField("page_start", T.IntegerType()),
    T.StructField("page_end", T.IntegerType()),
    T.StructField("raw_markdown", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

CHUNKS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("document_id", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("chunk_id", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("start_offset", T.IntegerType()),
    T.StructField("end_offset", T.IntegerType()),
    T.StructField("heading_context", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("processed_date", T.TimestampType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def create_tables(spark, prefix: str = "") -> None:
    """Create the four tables if they are absent; facts are partitioned by table."""
    for name, schema, by in (("documents", DOCUMENTS, None), ("table_registry", REGISTRY, None), ("document_facts", FACTS, "table_id"), ("document_chunks", CHUNKS, None)):
        if not spark.catalog.tableExists(f"{prefix}{name}"):
            w = spark.createDataFrame([], schema).write.format("parquet")
            (w.partitionBy(by) if by else w).saveAsTable(f"{prefix}{name}")
