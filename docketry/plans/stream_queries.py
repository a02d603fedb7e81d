"""Registered queries over event streams and change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import records
from docketry.plans.registry import query
from docketry.session import shared_dir
from docketry.sources import fixtures as fx
from docketry.streaming import debounce, fold, packets, requests, sink

FOLD = """en AS (SELECT stream_id, min(seq) FILTER (event IN ('done','error')) AS e FROM v_sse GROUP BY stream_id),
lv AS (SELECT v.* FROM v_sse v JOIN en ON en.stream_id = v.stream_id WHERE e IS NULL OR seq <= e),
ba AS (SELECT stream_id, max(seq) FILTER (event = 'replace') AS b, max(seq) AS last_seq, arg_max(event, seq) AS last_event, arg_max(text, seq) AS last_text FROM lv GROUP BY stream_id),
tk AS (SELECT lv.stream_id, string_agg(text, '' ORDER BY seq) AS t FROM lv JOIN ba ON ba.stream_id = lv.stream_id WHERE event = 'token' AND (b IS NULL OR seq > b) GROUP BY lv.stream_id),
rp AS (SELECT lv.stream_id, text AS r FROM lv JOIN ba ON ba.stream_id = lv.stream_id AND lv.seq = ba.b),
th AS (SELECT stream_id, string_agg(text, '' ORDER BY seq) AS t FROM lv WHERE event = 'reasoning' GROUP BY stream_id),
fo AS (SELECT ba.stream_id, CASE WHEN last_event = 'error' THEN last_text ELSE coalesce(r, '') || coalesce(tk.t, '') END AS answer, coalesce(th.t, '') AS reasoning,
  CASE WHEN last_event = 'error' THEN 'error' ELSE 'done' END AS status, CASE WHEN last_event = 'error' THEN 'stream_error' ELSE 'stop' END AS finish_reason, last_seq
  FROM ba LEFT JOIN tk ON tk.stream_id = ba.stream_id LEFT JOIN rp ON rp.stream_id = ba.stream_id LEFT JOIN th ON th.stream_id = ba.stream_id)"""


@query("folded_turns", "ST2 ST3", f"WITH {FOLD} SELECT * FROM fo", ("v_sse",))
def folded_turns(spark, sf_dir):
    return fold.fold_batch(fx.stream_events(spark, sf_dir)).select(
        "stream_id", "answer", "reasoning", "status", "finish_reason", "last_seq"
    )


def raw_packets(spark, sf_dir):
    """The same events as server-sent packets, some of them broken."""
    e = fx.stream_events(spark, sf_dir)
    name = F.when(F.col("event") == "error", "detail").otherwise("text")
    data = F.concat(F.lit('{"'), name, F.lit('":\r\ndata: '), F.to_json(F.struct("text")).substr(9, (1 << 31) - 1), F.lit(""))
    good = F.concat(F.lit("event: x\nevent: "), "event", F.lit("\ndata: "), data)
    k = F.col("seq") % 10
    packet = (
        F.when(k == 7, F.concat(F.lit("event: "), "event"))
        .when(k == 8, F.concat(F.lit("event: "), "event", F.lit("\ndata: {bad")))
        .when(k == 9, F.lit("data: {}"))
        .otherwise(good)
    )
    return e.select("stream_id", "seq", packet.alias("packet"))


@query(
    "parsed_packets",
    "S6 ST1",
    """SELECT stream_id, seq, CASE WHEN seq % 10 = 9 THEN 'message' ELSE event END AS event, CASE WHEN seq % 10 < 7 THEN text END AS text FROM v_sse WHERE seq % 10 NOT IN (7, 8)""",
    ("v_sse",),
)
def parsed_packets(spark, sf_dir):
    return packets.typed_events(packets.parse_packets(raw_packets(spark, sf_dir))).select("stream_id", "seq", "event", "text")


@query(
    "body_packets",
    "ST1",
    """SELECT stream_id, seq - 1 AS pos, event FROM (SELECT *, max(seq) OVER (PARTITION BY stream_id) AS last FROM v_sse) WHERE seq % 10 NOT IN (7, 8, 9) AND seq < last""",
    ("v_sse",),
)
def body_packets(spark, sf_dir):
    """Whole stream bodies cut into packets; the last packet is not terminated."""
    from docketry.operators.blocks import ordered_concat

    bodies = ordered_concat(raw_packets(spark, sf_dir), ["stream_id"], "seq", "packet", "body", "\n\n")
    e = packets.parse_packets(packets.split_bodies(bodies))
    return e.where(F.col("event") != "message").select("stream_id", F.col("seq").alias("pos"), "event")


def _run_stream(spark, frame, mode: str, schema):
    """Run a bounded stream to its end and give its output rows."""
    out = f"{shared_dir(spark, 'stream')}/rows"

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_to_end(spark, frame, mode, write)
    return spark.read.schema(schema).parquet(out)


def run_to_end(spark, frame, mode: str, write) -> None:
    """Run a bounded stream to its end; the session's state store setting is put back once the stream has read it."""
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rocks)
    try:
        stream = frame.writeStream.outputMode(mode).option("checkpointLocation", shared_dir(spark, "checkpoint"))
        running = stream.foreachBatch(write).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    running.awaitTermination()


def as_stream(spark, rows, parts: int, *by, files: int = 1):
    """The rows as a stream of ``parts`` batches of ``files`` files, dealt by a hash of ``by`` and so out of order."""
    path = shared_dir(spark, "input")
    rows.repartition(parts * files, F.xxhash64(*by)).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("folded_turns_stream", "S6 ST2 ST3", f"WITH {FOLD} SELECT * FROM fo", ("v_sse",))
def folded_turns_stream(spark, sf_dir):
    """The stateful fold over the events as a stream of files.

    Events are dealt over the files by number, out of order, and every fifth one comes twice.
    """
    events = fx.stream_events(spark, sf_dir)
    staged = f"{shared_dir(spark, 'events')}"
    again = events.where(F.col("seq") % 5 == 0).withColumn("_part", F.lit(1))
    dealt = events.withColumn("_part", F.lit(0)).unionByName(again)
    dealt.repartition(4, F.xxhash64("stream_id", "seq", "_part")).drop("_part").write.parquet(staged)
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(staged)
    updates = _run_stream(spark, fold.fold_stream(live), "update", fold.OUTPUT)
    return fold.close_open_turns(fold.latest_turns(updates)).select(
        "stream_id", "answer", "reasoning", "status", "finish_reason", "last_seq"
    )


GAPS = """g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY scope ORDER BY ts, seq) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM v_notes),
p AS (SELECT *, sum(n) OVER (PARTITION BY scope ORDER BY ts, seq) AS k FROM g)"""


@query(
    "debounced_notes",
    "ST4",
    f"""WITH {GAPS} SELECT scope, min(ts) AS first_ts, max(seq) AS seq, count(*) AS changes, arg_max(notes, seq) AS notes FROM p GROUP BY scope, k""",
    ("v_notes",),
)
def debounced_notes(spark, sf_dir):
    return debounce.debounced(fx.note_changes(spark, sf_dir), "notes", "6 hours").drop("saved_ts")


@query(
    "debounced_notes_stream",
    "ST4",
    f"""WITH {GAPS} SELECT scope, max(seq) AS seq, count(*) AS changes, arg_max(notes, seq) AS notes FROM p GROUP BY scope, k
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM v_notes)""",
    ("v_notes",),
)
def debounced_notes_stream(spark, sf_dir):
    """The same as a stream: periods that the watermark has passed."""
    notes = fx.note_changes(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    staged = shared_dir(spark, "notes")
    notes.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(staged)
    live = spark.readStream.schema(notes.schema).parquet(staged)
    quiet = debounce.debounced(live, "notes", "6 hours", "0 seconds")
    done = _run_stream(spark, quiet, "append", "scope bigint, first_ts timestamp, saved_ts timestamp, seq bigint, changes bigint, notes string")
    return done.select("scope", "seq", "changes", "notes")


@query(
    "latest_request_wins",
    "ST6",
    """SELECT scope, seq AS request_id, notes FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seq DESC) AS rn FROM v_notes) WHERE rn = 1""",
    ("v_notes",),
)
def latest_request_wins(spark, sf_dir):
    n = fx.note_changes(spark, sf_dir)
    requests = n.select("scope", F.col("seq").alias("request_id"), "seq")
    return debounce.latest_requests(n.select("scope", F.col("seq").alias("request_id"), "notes"), requests)


@query(
    "latest_request_wins_stream",
    "S6 ST6",
    """SELECT scope, request_id, CAST(request_id AS BIGINT) AS seq, body FROM (SELECT scope, seq AS request_id, notes AS body, row_number() OVER (PARTITION BY scope ORDER BY seq DESC) AS rn FROM v_notes) WHERE rn = 1 AND request_id % 5 <> 4""",
    ("v_notes",),
)
def latest_request_wins_stream(spark, sf_dir):
    """Requests and their answers as files out of order, so that answers come before their request; some have none."""
    n = fx.note_changes(spark, sf_dir).withColumn("request_id", F.col("seq"))
    told = n.where(F.col("seq") % 5 != 4).select("scope", "request_id", F.col("notes").alias("body"))
    events = requests.tagged(n.select("scope", "request_id", "seq"), told)
    updates = requests.latest_requests_stream(as_stream(spark, events, 4, "request_id", "kind"), None)
    shape = "scope bigint, request_id bigint, seq bigint, body string, answered boolean"
    return requests.settled(_run_stream(spark, updates, "update", shape))


@query(
    "body_pieces_stream",
    "S6 ST1",
    """SELECT stream_id, seq, CASE WHEN seq % 10 = 9 THEN 'message' ELSE event END AS event, CASE WHEN seq % 10 < 7 THEN text || 'é€' END AS text
FROM (SELECT *, max(seq) OVER (PARTITION BY stream_id) AS last FROM v_sse) WHERE seq % 10 NOT IN (7, 8) AND seq < last""",
    ("v_sse",),
)
def body_pieces_stream(spark, sf_dir):
    """Whole bodies cut at any byte, inside characters and line ends too, and dealt over files out of order."""
    from docketry.operators.blocks import ordered_concat

    accented = F.replace("packet", F.lit(' "}'), F.lit(' é€"}'))
    joined = ordered_concat(raw_packets(spark, sf_dir).withColumn("packet", accented), ["stream_id"], "seq", "packet", "body", "\r\n\r\n")
    body = F.col("body").cast("binary")
    step = (F.col("stream_id") % 37 + 11).cast("int")
    n = F.ceil(F.octet_length("body") / step).cast("int")
    pieces = joined.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    pieces = pieces.select("stream_id", F.col("piece").cast("bigint").alias("piece"), F.substring(body, F.col("piece") * step + 1, step).alias("body"))
    cut = packets.cut_pieces(as_stream(spark, pieces, 4, "stream_id", "piece"))
    found = _run_stream(spark, cut, "append", "stream_id bigint, seq bigint, packet string")
    return packets.typed_events(packets.parse_packets(found)).select("stream_id", "seq", "event", "text")


SESSION = "scope bigint, id bigint, title string, digest string, status string, finish_reason string, rag_note string, source_count bigint, turn_count bigint, created_s bigint, updated_s bigint"


@query(
    "saved_sessions_stream",
    "W9 ST5 W1 W3",
    """WITH l AS (SELECT scope, session_id AS id, arg_max(pos // 4, pos) AS part, arg_max(status, pos) AS status, count(*) AS n FROM v_turns GROUP BY ALL)
SELECT scope, id, 'part ' || part AS title, status, 1704067200 + id * 3600 AS created_s FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY id DESC) AS rn FROM l) WHERE rn <= 50""",
    ("v_turns",),
)
def saved_sessions_stream(spark, sf_dir):
    """A version of a session after every turn, most of them like the one before; the table that the changes leave."""
    t = fx.turns(spark, sf_dir)
    part = F.floor(F.col("pos") / 4)
    versions = t.select(
        "scope", F.col("session_id").alias("id"), F.concat(F.lit("part "), part.cast("string")).alias("title"), F.lit("").alias("digest"), "status", F.lit("").alias("finish_reason"),
        F.lit(None).cast("string").alias("rag_note"), F.lit(None).cast("bigint").alias("source_count"), part.cast("bigint").alias("turn_count"),
        (F.lit(1704067200) + F.col("session_id") * 3600).cast("bigint").alias("created_s"), F.col("ts_s").cast("bigint").alias("updated_s"),
    )
    path, stored = shared_dir(spark, "sessions"), SESSION + ", fingerprint string"
    run_to_end(spark, sink.changed_stream(as_stream(spark, versions, 4, "id", "updated_s")), "update", sink.session_writer(path, stored, 16))
    return sink.read_sessions(spark, path, stored).select("scope", "id", "title", "status", "created_s")


@query(
    "deleted_files",
    "J6",
    """SELECT scope, id, pos FROM v_file_changes f WHERE scope % 10 <> 3 AND NOT EXISTS (SELECT 1 FROM v_file_changes d WHERE d.scope = f.scope AND d.id = f.id AND d.name = ' File 1-URGENT ')""",
    ("v_file_changes",),
)
def deleted_files(spark, sf_dir):
    f = fx.file_changes(spark, sf_dir)
    gone = f.where(F.col("name") == " File 1-URGENT ").select("scope", F.concat(F.lit(" "), "id").alias("id"))
    gone = gone.unionByName(gone.select("scope", F.lit("  ").alias("id")))
    cleared = f.where(F.col("scope") % 10 == 3).select("scope")
    return records.clear_scopes(records.remove_keys(f, gone), cleared).select("scope", "id", "pos")


@query(
    "file_last_wins",
    "P2 W2",
    """SELECT scope, id, min(pos) AS pos, trim(arg_max(name, pos)) AS name, arg_max(size, pos) AS size, arg_max(added_at, pos) AS added_at FROM v_file_changes GROUP BY scope, id""",
    ("v_file_changes",),
)
def file_last_wins(spark, sf_dir):
    f = records.last_wins(fx.file_changes(spark, sf_dir), ["scope", "id"], "pos")
    return records.normalize_files(f)


UPSERT = """ev AS (SELECT *, CASE WHEN added_at < TIMESTAMP '1996-01-01' THEN 0 ELSE 1 END AS n FROM v_file_changes),
mg AS (SELECT scope, id, arg_max(name, n * 100000000 + pos) AS name, arg_min(added_at, n * 100000000 + pos) AS created_at, min(n) AS n0,
  min(pos) FILTER (n = 0) AS p0, min(pos) FILTER (n = 1) AS p1 FROM ev GROUP BY scope, id),
rk AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY CASE WHEN n0 = 0 THEN 1 ELSE 0 END, CASE WHEN n0 = 0 THEN p0 ELSE -p1 END) AS rn FROM mg)"""


def upserted(spark, sf_dir):
    f = fx.file_changes(spark, sf_dir).withColumnRenamed("added_at", "created_at")
    early = F.col("created_at") < F.lit("1996-01-01").cast("timestamp_ntz")
    current = f.where(early).select("scope", "id", "created_at", "name", "pos")
    changes = f.where(~early).select("scope", "id", "created_at", "name", F.col("pos").alias("version"))
    return records.upsert(current, changes, "version")


@query("upserted_records", "W1", f"WITH {UPSERT} SELECT scope, id, name, created_at FROM rk", ("v_file_changes",))
def upserted_records(spark, sf_dir):
    return upserted(spark, sf_dir).select("scope", "id", "name", "created_at")


@query(
    "upserted_and_capped",
    "W1 W3",
    f"WITH {UPSERT} SELECT scope, id, name, created_at FROM rk WHERE rn <= 50",
    ("v_file_changes",),
)
def upserted_and_capped(spark, sf_dir):
    return records.retain(upserted(spark, sf_dir), records.KEEP_CONSULTATIONS, F.col("place")).select("scope", "id", "name", "created_at")


@query(
    "newest_files",
    "W3 T1 S1",
    """SELECT scope, id, pos, added_at FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY added_at DESC, pos) AS rn FROM v_file_changes) WHERE rn <= 50""",
    ("v_file_changes",),
)
def newest_files(spark, sf_dir):
    f = records.latest(records.valid_ids(fx.file_changes(spark, sf_dir)), records.KEEP_FILES, "added_at")
    return records.newest_first(f, "added_at").select("scope", "id", "pos", "added_at")


@query(
    "first_files",
    "W3",
    """SELECT scope, id, pos FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY pos) AS rn FROM v_file_changes) WHERE rn <= 50""",
    ("v_file_changes",),
)
def first_files(spark, sf_dir):
    return records.retain(fx.file_changes(spark, sf_dir), records.KEEP_FILES, F.col("pos")).select("scope", "id", "pos")


@query(
    "normalized_users",
    "P5",
    r"""SELECT user_key, user_id, coalesce(user_id, 'anon') AS scope, CASE WHEN user_id IS NULL THEN 'records' ELSE 'records__' || user_id END AS storage_key, display_name FROM (
 SELECT user_key, left(nullif(trim(regexp_replace(trim(raw_id), '[^a-zA-Z0-9_.:@-]+', '_', 'g'), '_:.@-'), ''), 96) AS user_id, left(trim(display_name), 320) AS display_name FROM v_users)""",
    ("v_users",),
)
def normalized_users(spark, sf_dir):
    u = records.normalize_users(fx.users(spark, sf_dir).withColumnRenamed("raw_id", "user_id"))
    return u.select("user_key", "user_id", "scope", "storage_key", "display_name")


@query(
    "valid_records",
    "F1",
    "SELECT scope, pos FROM v_file_changes WHERE pos % 7 <> 0 AND pos % 11 <> 0",
    ("v_file_changes",),
)
def valid_records(spark, sf_dir):
    f = fx.file_changes(spark, sf_dir)
    loose = f.withColumn("id", F.when(F.col("pos") % 7 == 0, F.lit(None)).when(F.col("pos") % 11 == 0, " \t").otherwise(F.col("id")))
    return records.valid_ids(loose, need_text=True).select("scope", "pos")


@query(
    "normalized_consultations",
    "P1 F7",
    """SELECT session_id AS id, trim(question, ' ' || chr(10)) AS question, CASE WHEN status = 'error' THEN 'error' ELSE 'done' END AS status,
  CAST(CASE WHEN pos % 5 = 0 THEN 0 WHEN pos % 5 = 1 THEN 0 ELSE pos END AS BIGINT) AS source_count, CASE WHEN pos % 3 = 0 THEN 1704300000 ELSE ts_s END AS created_s,
  CASE WHEN pos % 3 = 0 THEN 1704300000 ELSE ts_s END >= 1704400000 - 604800 AS weekly FROM v_turns""",
    ("v_turns",),
)
def normalized_consultations(spark, sf_dir):
    from datetime import datetime, timezone

    from docketry.operators.dashboard import within_week

    t = fx.turns(spark, sf_dir)
    k = F.col("pos") % 5
    stamp = F.when(F.col("pos") % 3 != 0, F.timestamp_seconds("ts_s"))
    raw = t.select(
        F.col("session_id").alias("id"), "question", "answer", "status", "finish_reason", "rag_note",
        F.when(k == 0, F.lit(float("nan"))).when(k == 1, -3.0).otherwise(F.col("pos").cast("double")).alias("source_count"),
        stamp.alias("created_at"), stamp.alias("updated_at"),
    )
    n = records.normalize_consultations(raw, datetime.fromtimestamp(1704300000, timezone.utc))
    n = n.withColumn("created_s", F.unix_seconds("created_at"))
    return n.select("id", "question", "status", "source_count", "created_s", within_week("created_s", 1704400000).alias("weekly"))
