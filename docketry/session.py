"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings. All of them can be changed on a live session, and each one is about plan
# shape, not about results.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even when the next operator then needs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # merge session windows before the shuffle, so one hot key does not ship every row
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # long rows go to Python in small batches, so that a task's memory does not grow with their length
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # a repeated key in a JSON object: the last one counts, as in a browser
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "docketry", master: str | None = None, **extra: str) -> SparkSession:
    """A session for local runs and tests; on a cluster use ``tune(existing_session)``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    Only when a session of one machine names no folder (as in tests) a temporary one is made and
    recorded in the session, so that every later caller uses the same one. On a cluster the setting
    is required: executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docketry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, "docketry", f"{purpose}-{uuid.uuid4().hex}")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result that is read several times to the shared folder, and read it back.

    This cuts the lineage: later stages do not recompute it, and losing executors does not lose it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete staged results that nothing reads any more; what is computed from them must have been written."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(os.path.dirname(file))
            if f"{os.sep}docketry{os.sep}" in folder.toString():
                folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
