"""Sources and sinks of the record tables.

Tables are Parquet folders in hash buckets of ``scope`` (``buckets``), however many scopes there are; a write replaces only
the scopes it holds, and those named to it. A bucket that became empty holds one row without an id, which no reader gives.
Schemas are given, never inferred, so a scan reads no more than the columns a query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import schemas
from docketry.functions.text import text
from docketry.operators import records
from docketry.session import discard, staged
from docketry.sources.buckets import BUCKET, bucket_of, read_buckets, replace_buckets, touched


def read_log(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """A scoped record log; rows without an id are dropped."""
    if fmt == "parquet":
        return records.valid_ids(read_buckets(spark, path, schema).drop(BUCKET))
    return records.valid_ids(spark.read.schema(schema).format(fmt).load(path))


def read_consultations(spark: SparkSession, path: str, now, fmt: str = "parquet") -> DataFrame:
    return records.normalize_consultations(read_log(spark, path, schemas.CONSULTATION, fmt), now)


def read_files(spark: SparkSession, path: str, now, fmt: str = "parquet") -> DataFrame:
    return records.normalize_files(read_log(spark, path, schemas.FILE, fmt), now)


def read_templates(spark: SparkSession, path: str, now, fmt: str = "parquet") -> DataFrame:
    return records.normalize_templates(read_log(spark, path, schemas.TEMPLATE, fmt), now)


def write_log(df: DataFrame, path: str, scopes: DataFrame | None = None) -> None:
    """Write a normalised and capped log. The scopes present in ``df`` are replaced.

    ``scopes`` (scope) lists further ones that this write speaks for: without rows they become empty. Other scopes of
    the same buckets are read and written again; buckets without any of these scopes are not touched.
    """
    spark = df.sparkSession
    rows = staged(df.withColumn("scope", F.col("scope").cast("string")).withColumn(BUCKET, bucket_of("scope")), "log")
    named = rows.select("scope", BUCKET)
    if scopes is not None:
        named = named.union(scopes.select(F.col("scope").cast("string").alias("scope")).withColumn(BUCKET, bucket_of("scope")))
    named = staged(named.distinct(), "scopes")
    met = touched(named)
    if not met:
        return
    old = read_buckets(spark, path, rows.drop(BUCKET).schema).where(F.col(BUCKET).isin(met)).alias("o")
    kept = old.join(named.alias("n"), F.col("o.scope").eqNullSafe(F.col("n.scope")), "left_anti")
    # a bucket without any row would keep its old files
    marks = spark.createDataFrame([(b,) for b in met], f"{BUCKET} int")
    replace_buckets(rows.unionByName(kept).unionByName(marks, allowMissingColumns=True), path)
    discard(rows, named)


def write_consultations(df: DataFrame, path: str, now, scopes: DataFrame | None = None) -> None:
    clean = records.normalize_consultations(records.valid_ids(df, need_text=True), now)
    write_log(records.latest(clean, records.KEEP_CONSULTATIONS, "updated_at", "id"), path, scopes)


def write_templates(df: DataFrame, path: str, now, order: str = "pos", scopes: DataFrame | None = None) -> None:
    clean = records.last_wins(records.normalize_templates(df, now), ["scope", "id"], order)
    write_log(records.latest(clean, records.KEEP_TEMPLATES, "updated_at", order), path, scopes)


def write_files(df: DataFrame, path: str, now, order: str = "pos", scopes: DataFrame | None = None) -> None:
    """Files keep the given order: the first fifty of a scope stay."""
    write_log(records.retain(records.normalize_files(df, now), records.KEEP_FILES, F.col(order)), path, scopes)


def with_fallback(primary: DataFrame, snapshot: DataFrame, loaded: DataFrame) -> DataFrame:
    """S3: primary rows, and the snapshot for the scopes whose primary read failed.

    ``loaded`` lists the scopes that were read successfully; a successful empty read wins over the
    snapshot.
    """
    ok = loaded.select("scope").distinct()
    good = primary.join(ok, "scope", "left_semi")
    return good.unionByName(snapshot.join(ok, "scope", "left_anti"))


def refresh_snapshot(primary: DataFrame, loaded: DataFrame, path: str) -> None:
    """S3: a successful read refreshes the snapshot of its scopes, an empty one too."""
    write_log(primary.join(loaded.select("scope").distinct(), "scope", "left_semi"), path, loaded)


def read_documents(spark: SparkSession, path: str, **filters: str | None) -> DataFrame:
    """Catalog scan; given filters (category, doc_type, id, ...) reach the Parquet reader."""
    df = spark.read.schema(schemas.DOCUMENT).parquet(path)
    for name, value in filters.items():
        value = (value or "").strip()
        if value:
            df = df.where(F.col(name) == value)
    return df


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    return spark.read.schema(schemas.CHUNK).parquet(path)


def read_upload_responses(spark: SparkSession, path: str) -> DataFrame:
    """One JSON response per line; ``ingest.split_responses`` makes the three tables."""
    return spark.read.schema(schemas.UPLOAD_RESPONSE).option("allowSingleQuotes", "false").json(path)


def parse_upload_responses(bodies: DataFrame, column: str = "body") -> DataFrame:
    """S7 for responses that are already a text column."""
    parsed = F.from_json(column, schemas.UPLOAD_RESPONSE, {"allowSingleQuotes": "false"})
    return bodies.select(parsed.alias("r")).select("r.*").where(F.col("batch_id").isNotNull())


def read_model_bodies(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Raw response bodies, JSON or plain text; blank ones are dropped.

    One body in each file, or any number with a ``separator`` between them. ``request_id`` is the file's address.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read.option("wholetext", "true")
    raw = reader.text(path).select(F.col("value").alias("body"), F.input_file_name().alias("request_id"))
    return raw.where(text("body") != "")


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """A request log with a ``url`` column."""
    return spark.read.parquet(path).select("url")


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Stored session documents (``sessions.session_payloads``); ids become text."""
    write_log(payloads.select("scope", F.col("session_id").cast("string").alias("id"), "title", "payload"), path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_payloads`` stored, in the shape of stored records (``sessions.restore_turns``)."""
    stored = read_log(spark, path, "scope string, id string, title string, payload string")
    blank = F.lit("")
    return stored.select("scope", F.col("id").alias("session_id"), F.col("title").alias("question"), F.col("payload").alias("answer"),
                         F.lit("done").alias("status"), blank.alias("rag_note"), blank.alias("finish_reason"))
