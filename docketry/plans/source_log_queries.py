"""Registered queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import catalog, ingest, records, sessions
from docketry.plans.registry import query
from docketry.plans.session_queries import FINAL, W
from docketry.session import shared_dir
from docketry.sources import fixtures as fx
from docketry.sources import logs


@query(
    "fallback_snapshot",
    "S3",
    """SELECT scope, id, pos FROM v_file_changes WHERE CASE WHEN scope % 4 <> 0 THEN added_at >= TIMESTAMP '1996-01-01' AND scope <> 7 ELSE added_at < TIMESTAMP '1996-01-01' END""",
    ("v_file_changes",),
)
def fallback_snapshot(spark, sf_dir):
    """Every fourth scope failed to load; scope 7 loaded and is empty."""
    f = fx.file_changes(spark, sf_dir)
    late = F.col("added_at") >= F.lit("1996-01-01").cast("timestamp_ntz")
    loaded = f.where(F.col("scope") % 4 != 0).select("scope").distinct()
    return logs.with_fallback(f.where(late & (F.col("scope") != 7)), f.where(~late), loaded).select("scope", "id", "pos")


@query(
    "upload_response_parts",
    "S7 A6",
    """SELECT batch_id, count(*) FILTER (NOT failed) AS uploaded, count(*) FILTER (failed) AS errors, CAST(coalesce(sum(chunk_count) FILTER (NOT failed), 0) AS BIGINT) AS chunks FROM v_upload_rows GROUP BY batch_id""",
    ("v_upload_rows",),
)
def upload_response_parts(spark, sf_dir):
    """Responses written as JSON lines and read back with the nested schema."""
    u = fx.upload_rows(spark, sf_dir)
    up = F.struct(F.col("pos"), F.col("uploaded_id").alias("id"), F.col("file_name").alias("name"), F.col("chunk_count"))
    bad = F.struct(F.col("pos"), F.col("file_name").alias("filename"), F.lit("trop grand").alias("detail"))
    responses = u.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("failed"), up))).alias("uploaded"),
        F.array_sort(F.collect_list(F.when(F.col("failed"), bad))).alias("errors"),
    )
    path = shared_dir(spark, "responses")
    responses.write.json(path)
    _, uploaded, errors = ingest.split_responses(logs.read_upload_responses(spark, path))
    return ingest.batch_summary(uploaded, errors).select("batch_id", "uploaded", "errors", "chunks")


@query(
    "written_file_log",
    "S1 S2 P2 W3",
    """SELECT CAST(scope AS VARCHAR) AS scope, id, trim(name) AS name, size FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY pos) AS rn FROM v_file_changes) WHERE rn <= 50""",
    ("v_file_changes",),
)
def written_file_log(spark, sf_dir):
    """Capped write in two steps: the second replaces only its own scopes."""
    f = fx.file_changes(spark, sf_dir).withColumn("added_at", F.col("added_at").cast("timestamp"))
    path = shared_dir(spark, "files")
    logs.write_files(f.withColumn("name", F.when(F.col("scope") % 2 == 0, "old").otherwise(F.col("name"))), path, None)
    logs.write_files(f.where(F.col("scope") % 2 == 0), path, None)
    return logs.read_files(spark, path, None).select("scope", "id", "name", "size")


@query(
    "refreshed_snapshot",
    "S1 S2 S3",
    """SELECT CAST(scope AS VARCHAR) AS scope, id, pos FROM v_file_changes WHERE CASE WHEN scope % 4 <> 0 THEN added_at >= TIMESTAMP '1996-01-01' AND scope <> 7 ELSE added_at < TIMESTAMP '1996-01-01' END""",
    ("v_file_changes",),
)
def refreshed_snapshot(spark, sf_dir):
    """Every fourth scope failed to load and keeps its old snapshot; scope 7 loaded and is empty from then on."""
    f = fx.file_changes(spark, sf_dir).select("scope", "id", "pos", "added_at")
    late = F.col("added_at") >= F.lit("1996-01-01").cast("timestamp_ntz")
    path = shared_dir(spark, "snapshot")
    logs.write_log(f.where(~late).drop("added_at"), path)
    loaded = f.where(F.col("scope") % 4 != 0).select("scope").distinct()
    logs.refresh_snapshot(f.where(late & (F.col("scope") != 7)).drop("added_at"), loaded, path)
    return logs.read_log(spark, path, "id string, pos bigint, scope string").select("scope", "id", "pos")


@query(
    "cleared_scope_log",
    "S1 S2 J6",
    """SELECT CAST(scope AS VARCHAR) AS scope, id, trim(name) AS name, size FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY pos) AS rn FROM v_file_changes WHERE scope % 5 <> 0) WHERE rn <= 50""",
    ("v_file_changes",),
)
def cleared_scope_log(spark, sf_dir):
    """A log written again after every file of some scopes was deleted."""
    f = fx.file_changes(spark, sf_dir).withColumn("added_at", F.col("added_at").cast("timestamp"))
    path = shared_dir(spark, "cleared")
    logs.write_files(f, path, None)
    gone = f.where(F.col("scope") % 5 == 0).select("scope", "id").distinct()
    logs.write_files(records.remove_keys(f, gone), path, None, scopes=f)
    return logs.read_files(spark, path, None).select("scope", "id", "name", "size")


@query(
    "catalog_scan",
    "S4",
    """SELECT CAST(doc_id AS VARCHAR) AS id, title, doc_type, size FROM v_catalog WHERE category = '02 — Droit civil' AND doc_type = 'Loi'""",
    ("v_catalog",),
)
def catalog_scan(spark, sf_dir):
    """A stored catalog read with two filters, which reach the Parquet reader."""
    path = shared_dir(spark, "catalog")
    fx.catalog(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string")).write.parquet(path)
    found = logs.read_documents(spark, path, category=" 02 — Droit civil", doc_type="Loi", id="")
    return found.select("id", "title", "doc_type", F.col("size").cast("bigint").alias("size"))


@query("chunk_scan", "S5", "SELECT chunk_id, page_start, length(text) AS chars FROM v_chunks", ("v_chunks",))
def chunk_scan(spark, sf_dir):
    path = shared_dir(spark, "chunks")
    fx.chunks(spark, sf_dir).write.parquet(path)
    return logs.read_chunks(spark, path).select("chunk_id", "page_start", F.length("text").alias("chars"))


@query("model_bodies", "S8", "SELECT answer AS body, count(*) AS bodies FROM v_model_outputs GROUP BY answer", ("v_model_outputs",))
def model_bodies(spark, sf_dir):
    """Raw bodies, some of several lines, behind a separator of their own; blank ones between them are dropped."""
    path, separator = shared_dir(spark, "bodies"), "\x1e"
    fx.model_outputs(spark, sf_dir).select(F.concat("answer", F.lit(separator + " ")).alias("value")).write.option("lineSep", separator).text(path)
    return logs.read_model_bodies(spark, path, separator).groupBy("body").agg(F.count(F.lit(1)).alias("bodies"))


@query(
    "url_log",
    "S9 X22 P15",
    """SELECT item_id AS request_id, trim(split_part(text, ' ', 2)) AS q, item_id % 3 + 1 AS page FROM benchmark""",
)
def url_log(spark, sf_dir):
    """Library links written as a request log, read back and taken apart."""
    path = shared_dir(spark, "urls")
    r = fx.search_requests(spark, sf_dir)
    link = catalog.build_query({"q": F.col("q"), "documentId": F.col("request_id").cast("string")})
    r.select(F.concat(F.lit("https://library.example/bibliotheque"), link).alias("url"), F.lit(200).alias("status")).write.parquet(path)
    found = catalog.parse_search_urls(logs.read_urls(spark, path))
    number = F.col("document_id").cast("bigint")
    return found.select(number.alias("request_id"), "q", (number % 3 + 1).alias("page"))


@query(
    "stored_payloads",
    "S10 X13 S1 S2",
    f"""SELECT CAST(scope AS VARCHAR) AS scope, CAST(session_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS BIGINT) AS pos, trim(question, {W}) AS question, answer, status
 FROM v_turns WHERE {FINAL}""",
    ("v_turns",),
)
def stored_payloads(spark, sf_dir):
    """Session documents written as a log, read back and restored."""
    t = fx.turns(spark, sf_dir)
    path = shared_dir(spark, "payloads")
    logs.write_payloads(sessions.session_payloads(sessions.finalized(t), sessions.roll_up(t)), path)
    return sessions.restore_turns(logs.read_payloads(spark, path)).select("scope", "session_id", "pos", "question", "answer", "status")
