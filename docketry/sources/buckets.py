"""Parquet tables in hash buckets of a key, of which a write replaces only the buckets it touches.

The partition column ``bucket`` is all that such a folder knows beyond plain Parquet; any reader can read it. New content of the
touched buckets is first written whole beside the table and then replaces their partitions, so a write that was cut off
is finished by the next one, or by the next read.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
BUCKET = "bucket"


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    """Bucket of a key as text, so that a number and its text are in one; NULL is a key like any other."""
    return F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_buckets(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table with its column ``bucket``; empty before the first write. ``schema``: its other columns."""
    finish(spark, path)
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn(BUCKET, F.lit(0))
    return spark.read.schema(schema).parquet(path).withColumn(BUCKET, F.col(BUCKET).cast("int"))


def touched(rows: DataFrame) -> list[int]:
    """The buckets that hold any of the rows (at most their number)."""
    return [r[BUCKET] for r in rows.select(BUCKET).distinct().collect()]


def replace_buckets(rows: DataFrame, path: str) -> None:
    """Make ``rows`` (with ``bucket``) the whole content of the buckets they are in; all other buckets keep their files.

    ``rows`` may be computed from the table itself.
    """
    spark = rows.sparkSession
    finish(spark, path)
    # one writer for a bucket; a bucket beyond a partition's usual size is split among several
    rows.hint("rebalance", BUCKET).write.mode("overwrite").parquet(_ahead(path))
    finish(spark, path)


def finish(spark: SparkSession, path: str) -> None:
    """Put complete new content that waits beside the table in its place."""
    ahead = _ahead(path)
    if exists(spark, os.path.join(ahead, "_SUCCESS")):
        rows = spark.read.parquet(ahead).hint("rebalance", BUCKET)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
        _delete(spark, ahead)


def _ahead(path: str) -> str:
    return path.rstrip("/") + "_next"
