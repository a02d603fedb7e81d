"""Record types shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

OPTION = T.StructType([T.StructField("value", T.StringType()), T.StructField("label", T.StringType())])

FIELD = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("required", T.BooleanType()),
        T.StructField("placeholder", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("options", T.ArrayType(OPTION)),
        T.StructField("hint", T.StringType()),
    ]
)

CONSULTATION = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("finish_reason", T.StringType()),
        T.StructField("rag_note", T.StringType()),
        T.StructField("source_count", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

FILE = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("added_at", T.TimestampType()),
    ]
)

STRINGS = T.ArrayType(T.StringType())

TEMPLATE = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("branch", T.StringType()),
        T.StructField("complexity", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("legal_refs", STRINGS),
        T.StructField("required_fields", STRINGS),
        T.StructField("optional_fields", STRINGS),
        T.StructField("sections", STRINGS),
        T.StructField("warning", T.StringType()),
        T.StructField("fields", T.ArrayType(FIELD)),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# A source inside a stored turn. Numbers are doubles: they come from JSON.
SOURCE = T.StructType(
    [
        T.StructField("rank", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("citation", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("page_start", T.DoubleType()),
        T.StructField("page_end", T.DoubleType()),
        T.StructField("article_hint", T.StringType()),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("page_start", T.IntegerType()),
        T.StructField("page_end", T.IntegerType()),
        T.StructField("article_hint", T.StringType()),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "id", "title", "description", "category", "doc_type", "section_label", "section_title",
            "block_code", "block_title", "block_label", "sub_category", "curation_note", "folder",
            "file_name", "relative_path", "download_url",
        )
    ]
    + [
        T.StructField("section_number", T.IntegerType()),
        T.StructField("is_duplicate", T.BooleanType()),
        T.StructField("size", T.LongType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

UPLOADED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("chunk_count", T.StringType()),
        T.StructField("relative_path", T.StringType()),
    ]
)
UPLOAD_ERROR = T.StructType([T.StructField("filename", T.StringType()), T.StructField("detail", T.StringType())])

UPLOAD_RESPONSE = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField(
            "items",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("name", T.StringType()),
                        T.StructField("size", T.DoubleType()),
                        T.StructField("added_at", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("uploaded", T.ArrayType(UPLOADED)),
        T.StructField("errors", T.ArrayType(UPLOAD_ERROR)),
    ]
)
