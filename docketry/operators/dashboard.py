"""Dashboard numbers per scope (A1), recent lists (T3), readable sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import half_up

WEEK_SECONDS = 7 * 24 * 3600
RECENT = 8
SIDEBAR = 20


def within_week(created_s: str, as_of_s) -> Column:
    """created in the seven days before ``as_of``, the edge included; no date is outside."""
    return F.coalesce(F.col(created_s) >= F.lit(as_of_s) - WEEK_SECONDS, F.lit(False))


def statistics(consultations: DataFrame, files: DataFrame, documents: DataFrame, as_of_s: int) -> DataFrame:
    """A1. Consultations need: scope, status, source_count, created_s. Files: scope, size."""
    c = consultations.groupBy("scope").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum("source_count").cast("bigint").alias("sources"),
        F.count_if(within_week("created_s", as_of_s)).alias("weekly"),
    )
    usable = ~F.isnan("size") & (F.abs("size") != float("inf"))
    f = files.groupBy("scope").agg(
        F.count(F.lit(1)).alias("files"),
        F.round(F.sum(F.when(usable, F.col("size")).otherwise(0.0)), 2).alias("bytes"),
    )
    zero = F.lit(0).cast("bigint")
    joined = c.join(f, "scope", "full_outer")
    numbers = {n: F.coalesce(F.col(n), zero) for n in ("total", "done", "errors", "sources", "weekly", "files")}
    library = documents.agg(F.count(F.lit(1))).scalar()
    return joined.select(
        "scope",
        *[v.alias(k) for k, v in numbers.items()],
        F.coalesce("bytes", F.lit(0.0)).alias("bytes"),
        F.when(F.col("total") > 0, F.round(F.col("sources") / F.col("total"), 1)).otherwise(0.0).alias("avg_sources"),
        F.when(F.col("total") > 0, half_up(F.col("done") / F.col("total") * 100)).otherwise(zero).alias("success_percent"),
        library.alias("library_documents"),
    )


def recent(df: DataFrame, keep: int = RECENT, updated: str = "updated_s", tie: str = "session_id") -> DataFrame:
    """The newest ``keep`` rows of every scope with their rank."""
    w = Window.partitionBy("scope").orderBy(F.col(updated).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def _one_decimal(x: Column) -> Column:
    return F.round(x.cast("decimal(38,10)"), 1).cast("decimal(20,1)").cast("string")


def volume(c) -> Column:
    """X20, report form: B to GB; whole numbers from 10 on, otherwise one decimal."""
    b = (F.col(c) if isinstance(c, str) else c).cast("double")
    out = F.lit("0 B")
    usable = ~F.isnan(b) & (b != float("inf")) & (b > 0)
    label = F.concat(half_up(b).cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        scaled = b / float(1024**power)
        shown = F.when(scaled >= 10, half_up(scaled).cast("string")).otherwise(_one_decimal(scaled))
        label = F.when(b >= 1024**power, F.concat(shown, F.lit(f" {unit}"))).otherwise(label)
    return F.when(usable, label).otherwise(out)


def file_size(c) -> Column:
    """X20, file list form: bytes, or KB / MB with one decimal."""
    b = F.col(c) if isinstance(c, str) else c
    return (
        F.when(b <= 0, "0 B")
        .when(b < 1024, F.concat(b.cast("bigint").cast("string"), F.lit(" B")))
        .when(b < 1024 * 1024, F.concat(_one_decimal(b / 1024.0), F.lit(" KB")))
        .otherwise(F.concat(_one_decimal(b / (1024.0 * 1024.0)), F.lit(" MB")))
    )
