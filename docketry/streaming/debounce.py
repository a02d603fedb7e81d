"""ST4 trailing debounce, ST6 latest request wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAVE_GAP = "250 milliseconds"
SEARCH_GAP = "260 milliseconds"


def debounced(changes: DataFrame, value: str, gap: str = SAVE_GAP, delay: str | None = None) -> DataFrame:
    """ST4: one row per quiet period: the last value before ``gap`` passed without a change.

    Works on a table and on a stream. On a stream give ``delay``, the lateness to wait for; a
    period is then emitted once the watermark has passed its end. Sessions are merged inside every
    map task before the shuffle.
    """
    rows = changes.withWatermark("ts", delay) if delay and changes.isStreaming else changes
    quiet = rows.groupBy("scope", F.session_window("ts", gap).alias("w")).agg(
        F.max_by(F.col(value), F.struct("ts", "seq")).alias(value), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("changes")
    )
    return quiet.select("scope", F.col("w.start").alias("first_ts"), F.col("w.end").alias("saved_ts"), "seq", "changes", value)


def latest_requests(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """ST6: responses whose request is still the newest one of its scope; of equal numbers the larger id is newer.

    ``requests``: scope, request_id, seq; ``responses``: scope, request_id, ... The streaming form is in ``requests``.
    """
    newest = requests.groupBy("scope").agg(F.max_by("request_id", F.struct("seq", "request_id")).alias("request_id"))
    return responses.join(newest, ["scope", "request_id"], "left_semi")
