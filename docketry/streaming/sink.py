"""ST5: changed-only saving of session records, on a stream.

``changed_stream`` lets a record pass when its content differs from the last one that passed (its fingerprint is the
state). ``session_writer`` merges what passed into a table in hash buckets of scopes: only buckets with a change are
read and rewritten, all others keep their files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docketry.operators import records
from docketry.operators.sessions import fingerprint
from docketry.session import discard, staged
from docketry.sources.buckets import BUCKET, BUCKETS, bucket_of, read_buckets, replace_buckets, touched

COMPARED = ["title", "digest", "status", "finish_reason", "rag_note", "source_count", "turn_count"]
# times keep their microseconds on the way through JSON
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def changed_records(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows that are new, or whose content differs from the stored row and that are not older than it."""
    old = stored.select("scope", "id", F.col("fingerprint").alias("_old"), F.col("updated_s").alias("_at"))
    new = incoming.withColumn("fingerprint", fingerprint(*COMPARED))
    joined = new.join(old, ["scope", "id"], "left")
    newer = (F.col("_old") != F.col("fingerprint")) & F.coalesce(F.col("updated_s") >= F.col("_at"), F.lit(True))
    return joined.where(F.col("_old").isNull() | newer).drop("_old", "_at")


def merge(stored: DataFrame, changes: DataFrame, keep: int = records.KEEP_CONSULTATIONS) -> DataFrame:
    """W1 + sorted cap: creation time of the stored row is kept, newest ``keep`` rows per scope."""
    columns = stored.columns
    rest = [c for c in columns if c not in ("scope", "id", "created_s")]
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.select(*columns).withColumn("_new", F.lit(1)))
    merged = both.groupBy("scope", "id").agg(
        F.max_by(F.struct(*rest), F.struct("_new", "updated_s")).alias("_w"), F.min_by("created_s", F.struct("_new", "updated_s")).alias("created_s")
    )
    flat = merged.select("scope", "id", "created_s", *[F.col("_w")[c].alias(c) for c in rest])
    return records.retain(flat, keep, F.col("updated_s").desc(), F.col("id")).select(*columns)


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of one record in an Arrow batch the newest, before the shuffle; a tie leaves the later row."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).append_column("_row", pa.array(range(batch.num_rows), pa.int64()))
        order = pc.sort_indices(table, [("updated_s", "ascending"), ("_row", "ascending")])
        last = table.take(order).group_by(["scope", "id"], use_threads=False).aggregate([("_row", "last")])
        yield batch.take(last.column("_row_last").combine_chunks())


class LastSaved(StatefulProcessor):
    """State of one record: the content and the time of the row that passed last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._saved = handle.getValueState("saved", "fingerprint string, updated_s bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for frame in rows:
            last = frame.iloc[[frame["updated_s"].to_numpy().argmax()]]
            if newest is None or last["updated_s"].iloc[0] >= newest["updated_s"].iloc[0]:
                newest = last
        content, at = newest["fingerprint"].iloc[0], int(newest["updated_s"].iloc[0])
        if self._saved.exists():
            old, since = self._saved.get()
            if old == content or at < since:
                return
        self._saved.update((content, at))
        yield newest

    def close(self) -> None:
        pass


def changed_stream(incoming: DataFrame) -> DataFrame:
    """Records of a stream (scope, id, updated_s, COMPARED and others) that differ from what passed before.

    Update mode, RocksDB. Of the rows of one record in a batch only the newest counts; one older than what passed does
    not. Rows without scope, id or time are dropped. Numbers that may be NULL come out as they went in.
    """
    known = incoming.where(F.col("scope").isNotNull() & F.col("id").isNotNull() & F.col("updated_s").isNotNull())
    rows = known.withColumn("fingerprint", fingerprint(*COMPARED))
    # the row travels as one JSON text: pandas has no whole numbers with NULLs among them
    rest = F.to_json(F.struct(*incoming.columns), MICROS).alias("record")
    narrow = rows.select("scope", "id", F.col("updated_s").cast("bigint").alias("updated_s"), "fingerprint", rest)
    fewer = narrow.mapInArrow(_newest, narrow.schema)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields)
    passed = fewer.groupBy("scope", "id").transformWithStateInPandas(statefulProcessor=LastSaved(), outputStructType=kind, outputMode="update", timeMode="none")
    whole = F.from_json("record", incoming.schema, MICROS)
    return passed.select(whole.alias("r")).select("r.*")


def read_sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The saved records; an empty table before the first change."""
    return read_buckets(spark, path, schema).drop(BUCKET)


def session_writer(path: str, schema: str, buckets: int = BUCKETS, keep: int = records.KEEP_CONSULTATIONS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the table below ``path`` up to date.

    ``schema``: the stored columns, ``fingerprint`` among them. Only buckets with a change are read and rewritten. A batch
    that is run again finds no change and writes nothing; one that was cut off while writing is finished first.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        incoming = staged(batch.withColumn(BUCKET, bucket_of("scope", buckets)), "incoming")
        met = touched(incoming)
        if not met:
            return
        stored = read_buckets(batch.sparkSession, path, schema).where(F.col(BUCKET).isin(met))
        changes = staged(changed_records(incoming, stored), "changes")
        changed = touched(changes)
        if changed:
            merged = merge(stored.where(F.col(BUCKET).isin(changed)).drop(BUCKET), changes, keep)
            replace_buckets(merged.withColumn(BUCKET, bucket_of("scope", buckets)), path)
        discard(incoming, changes)

    return write
