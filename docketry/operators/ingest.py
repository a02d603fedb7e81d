"""Upload batches: reconciliation, summaries, new files, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import or_default, strip, text
from docketry.operators.blocks import RANK_BLOCK, TEXT_BLOCK, block_rank, by_key, ordered_concat, row_counts

PAPERCLIP = "\U0001f4ce"
LABEL_NAMES = 3
DIGEST_FAILED, DIGEST_PARTIAL = 3, 2
FILE, UPLOADED, ERROR = "file", "uploaded", "error"


def split_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, uploaded, errors) of nested upload responses, each with batch_id and pos."""
    def part(name):
        return responses.select("batch_id", F.posexplode(name).alias("pos", "x")).select(
            "batch_id", F.col("pos").cast("bigint").alias("pos"), "x.*"
        )

    return part("items"), part("uploaded"), part("errors")


def tagged_uploads(files: DataFrame, uploaded: DataFrame, errors: DataFrame) -> DataFrame:
    """Chosen files, uploaded rows and errors of all batches in one table.

    ``files``: batch_id, pos, name; ``uploaded``: batch_id, pos, id and chunk_count if known; ``errors``: batch_id, filename,
    and pos and detail if known.
    """
    none = F.lit(None).cast("string")
    chunks = F.coalesce(F.col("chunk_count").try_cast("double"), F.lit(0.0)) if "chunk_count" in uploaded.columns else F.lit(0.0)
    place = F.col("pos").cast("bigint") if "pos" in errors.columns else F.lit(0).cast("bigint")
    line = F.concat("filename", F.lit(": "), "detail") if "detail" in errors.columns else none

    def rows(df, kind, pos, name, id_, n, line_):
        return df.select("batch_id", F.lit(kind).alias("kind"), pos.alias("pos"), name.alias("name"), id_.alias("id"), n.alias("chunks"), line_.alias("line"))

    zero = F.lit(0.0)
    pos = F.col("pos").cast("bigint")
    return (
        rows(files, FILE, pos, F.col("name"), none, zero, none)
        .unionByName(rows(uploaded, UPLOADED, pos, none, text("id"), F.when(F.isnan(chunks), 0.0).otherwise(chunks), none))
        .unionByName(rows(errors, ERROR, place, F.col("filename"), none, zero, line))
    )


def _zipped(tagged: DataFrame, n_rows: int) -> DataFrame:
    """Every tagged row with its rank in its group and, for a kept file, the uploaded id of the same rank.

    All windows are cut by the batch, so one shuffle by batch serves them all; the tasks grow in number with the rows.
    """
    rows = by_key(tagged, n_rows, "batch_id").withColumn("_n", F.lower(text("name")))
    same_name, batch = Window.partitionBy("batch_id", "_n"), Window.partitionBy("batch_id")
    is_file, is_up = F.col("kind") == FILE, F.col("kind") == UPLOADED
    marked = rows.withColumns(
        {
            "_failed": is_file & (F.col("_n") != "") & F.max(F.col("kind") == ERROR).over(same_name),
            # a row without id takes nobody, and nobody behind it gets one
            "_stop": F.min(F.when(is_up & (F.col("id") == ""), F.col("pos"))).over(batch),
        }
    )
    marked = marked.withColumn("_pairs", (is_file & ~F.col("_failed")) | (is_up & (F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))))
    ranked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy("batch_id", "kind", "_pairs").orderBy("pos")))
    partner = F.max(F.when(is_up & F.col("_pairs"), F.col("id"))).over(Window.partitionBy("batch_id", "_pairs", "_rank"))
    return ranked.withColumn("file_id", F.when(is_file & F.col("_pairs"), partner))


def _outcomes(zipped: DataFrame) -> DataFrame:
    outcome = F.when(F.col("_failed"), "failed").when(F.col("file_id").isNotNull(), "uploaded").otherwise("waiting")
    return zipped.where(F.col("kind") == FILE).select("batch_id", "pos", "name", "file_id", outcome.alias("outcome"))


def reconcile(files: DataFrame, uploaded: DataFrame, errors: DataFrame, block: int = RANK_BLOCK) -> DataFrame:
    """Which uploaded row belongs to which chosen file.

    Files whose lower-case name is among the errors of the batch failed. The others take the
    uploaded rows in order; a row without id takes nobody, and nobody behind it gets one.
    A batch of more than ``block`` rows is ranked in blocks.
    """
    tagged = tagged_uploads(files, uploaded, errors)
    rows, most = row_counts(tagged, ["batch_id"])
    if most <= block:
        return _outcomes(_zipped(tagged, rows))
    return _reconcile_in_blocks(files, uploaded, errors, block)


def _reconcile_in_blocks(files: DataFrame, uploaded: DataFrame, errors: DataFrame, block: int) -> DataFrame:
    """The same by joins, for batches that one task should not hold."""
    failed_names = errors.select("batch_id", F.lower(text("filename")).alias("_n")).where(F.col("_n") != "").distinct()
    named = files.withColumn("_n", F.lower(text("name")))
    failed = named.join(failed_names, ["batch_id", "_n"], "left_semi")
    kept = block_rank(named.join(failed_names, ["batch_id", "_n"], "left_anti"), ["batch_id"], "pos", "_rank", block)
    ids = uploaded.withColumn("_id", text("id"))
    first_blank = ids.groupBy("batch_id").agg(F.min(F.when(F.col("_id") == "", F.col("pos"))).alias("_stop"))
    live = ids.join(first_blank, "batch_id").where(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
    slots = block_rank(live.select("batch_id", "pos", "_id"), ["batch_id"], "pos", "_rank", block).select(
        "batch_id", "_rank", F.col("_id").alias("file_id")
    )
    taken = kept.join(slots, ["batch_id", "_rank"], "left")
    columns = ["batch_id", "pos", "name"]
    return taken.select(
        *columns, "file_id", F.when(F.col("file_id").isNotNull(), "uploaded").otherwise("waiting").alias("outcome")
    ).unionByName(failed.select(*columns, F.lit(None).cast("string").alias("file_id"), F.lit("failed").alias("outcome")))


def upload_report(files: DataFrame, uploaded: DataFrame, errors: DataFrame, block: int = RANK_BLOCK) -> tuple[DataFrame, DataFrame]:
    """J7 and A6 of the same batches: (outcome of every file, summary of every batch), from one pass over the three tables."""
    tagged = tagged_uploads(files, uploaded, errors)
    n_rows, most = row_counts(tagged, ["batch_id"])
    if most > block:
        outcomes = _reconcile_in_blocks(files, uploaded, errors, block)
        return outcomes, batch_summary(uploaded, errors, outcomes)
    zipped = _zipped(tagged, n_rows)
    is_up, is_error = F.col("kind") == UPLOADED, F.col("kind") == ERROR
    lines = F.collect_list(F.when(is_error & (F.col("_rank") <= DIGEST_FAILED), F.struct("_rank", F.col("line").alias("_line"))))
    rows = zipped.groupBy("batch_id").agg(
        F.count_if(is_up).alias("uploaded"),
        F.sum(F.when(is_up, F.col("chunks"))).cast("bigint").alias("chunks"),
        F.count("file_id").alias("_ids"),
        F.count_if(is_error).alias("errors"),
        F.array_sort(lines).alias("_lines"),
    )
    rows = rows.where((F.col("uploaded") > 0) | (F.col("errors") > 0)).withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("bigint")))
    return _outcomes(zipped), _summary(rows)


def batch_summary(uploaded: DataFrame, errors: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Counts, chunk total, error digest and outcome of every batch.

    ``resolved`` (result of ``reconcile``) decides whether an upload without usable file counts as
    "no-chunks"; without it the uploaded ids decide.
    """
    chunks = F.coalesce(F.col("chunk_count").try_cast("double"), F.lit(0.0))
    finite = F.when(F.isnan(chunks), 0.0).otherwise(chunks)
    up = uploaded.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("uploaded"),
        F.sum(finite).cast("bigint").alias("chunks"),
        F.count_if(text("id") != "").alias("_ids"),
    )
    if resolved is not None:
        usable = resolved.groupBy("batch_id").agg(F.count("file_id").alias("_ids"))
        up = up.drop("_ids").join(usable, "batch_id", "left")
    bad = errors.groupBy("batch_id").agg(F.count(F.lit(1)).alias("errors"))
    # only the first lines of the digest leave a task
    w = Window.partitionBy("batch_id").orderBy("pos")
    head = (
        errors.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= DIGEST_FAILED)
        .withColumn("_line", F.concat("filename", F.lit(": "), "detail"))
        .groupBy("batch_id")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "_line"))).alias("_lines"))
    )
    rows = up.join(bad, "batch_id", "full_outer").join(head, "batch_id", "left")
    zero = F.lit(0).cast("bigint")
    return _summary(rows.withColumns({c: F.coalesce(F.col(c), zero) for c in ("uploaded", "chunks", "errors", "_ids")}))


def _summary(rows: DataFrame) -> DataFrame:
    """Digest and outcome from the counts and the first error lines of every batch."""
    none, some = F.col("uploaded") == 0, F.col("errors") > 0
    shown = F.slice("_lines", F.lit(1), F.when(none, DIGEST_FAILED).otherwise(DIGEST_PARTIAL))
    digest = F.array_join(F.transform(shown, lambda x: x["_line"]), " | ")
    outcome = (
        F.when(none & some, "failed")
        .when(F.col("_ids") == 0, "no-chunks")
        .when(some, "partial")
        .otherwise("ok")
    )
    return rows.select("batch_id", "uploaded", "chunks", "errors", F.coalesce(digest, F.lit("")).alias("digest"), outcome.alias("outcome"))


def file_key() -> Column:
    """Identity of a chosen file."""
    return F.concat_ws("|", "name", F.col("size").cast("string"), F.col("last_modified").cast("string"))


def new_files(chosen: DataFrame, pending: DataFrame) -> DataFrame:
    """Chosen files that are not pending yet. Both need scope, name, size, last_modified."""
    known = pending.select("scope", file_key().alias("_key")).distinct()
    return chosen.withColumn("_key", file_key()).join(known, ["scope", "_key"], "left_anti").drop("_key")


def submitted_ids(attached: DataFrame) -> DataFrame:
    """The distinct ids of the attached files of every request, one row each.

    ``attached``: request_id, pos, pre_id, new_id. The order of a request's ids is (turn, at): earlier
    uploads (turn 0) first, then by position. A request with attachments but without any id is rejected;
    it has one row whose id is NULL.
    """
    both = attached.select(
        "request_id",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("turn"), F.col("pos").alias("at"), text("pre_id").alias("file_id")),
                F.struct(F.lit(1).alias("turn"), F.col("pos").alias("at"), text("new_id").alias("file_id")),
            )
        ),
    )
    ids = both.where(F.col("file_id") != "").groupBy("request_id", "file_id").agg(F.min(F.struct("turn", "at")).alias("_first"))
    counted = attached.groupBy("request_id").agg(F.count(F.lit(1)).alias("attachments"))
    per = ids.groupBy("request_id").agg(F.count(F.lit(1)).alias("ids"))
    return counted.join(per, "request_id", "left").join(ids, "request_id", "left").select(
        "request_id",
        "attachments",
        F.coalesce("ids", F.lit(0).cast("bigint")).alias("ids"),
        F.coalesce(F.col("ids") == 0, F.lit(True)).alias("rejected"),
        "file_id",
        F.col("_first")["turn"].alias("turn"),
        F.col("_first")["at"].alias("at"),
    )


def attachment_preview(files: DataFrame, key: str, block: int = TEXT_BLOCK) -> DataFrame:
    """The first three names and how many more there are. ``files``: key, pos, name."""
    named = files.withColumn("name", text("name")).where(F.col("name") != "")
    counts = named.groupBy(key).agg(F.count(F.lit(1)).alias("files"))
    w = Window.partitionBy(key).orderBy("pos")
    head = named.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= LABEL_NAMES)
    names = ordered_concat(head, [key], "pos", "name", "_names", ", ", block)
    more = F.when(F.col("files") > LABEL_NAMES, F.concat(F.lit(" +"), (F.col("files") - LABEL_NAMES).cast("string"))).otherwise("")
    return counts.join(names, key).select(key, "files", F.concat("_names", more).alias("preview"))


def display_question(question, preview, documents_only=False) -> Column:
    """What is shown for a question with attachments."""
    only = documents_only if isinstance(documents_only, Column) else F.lit(documents_only)
    base = F.when(only, "Analyse du document joint").otherwise(or_default(question, "Question"))
    shown = F.coalesce(strip(preview), F.lit(""))
    return F.when(shown == "", base).otherwise(F.concat(base, F.lit(f"\n{PAPERCLIP} "), shown))
