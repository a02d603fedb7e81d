"""Streams must give what the batch job gives, whatever the batches are."""

import os
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.plans import stream_queries
from docketry.sources import buckets
from docketry.streaming import debounce, fold, packets, requests, sink

SCHEMA = "stream_id bigint, seq bigint, event string, text string, note string, reason string, sources string"
EVENTS = [
    (1, 1, "meta", None, "m", None, '["s"]'), (1, 2, "token", "a", None, None, None), (1, 3, "replace", "B", None, None, None),
    (1, 4, "token", "c", None, None, None), (1, 5, "done", None, None, None, None), (1, 6, "token", "late", None, None, None),
    (2, 1, "token", "x", None, None, None), (2, 2, "reasoning", "why", None, None, None), (2, 3, "error", None, None, None, None),
    (3, 1, "token", "open", None, None, None), (3, 2, "replace", None, None, None, None), (4, 1, "error", "no net", None, "network_error", None),
]
WANT = {
    1: ("Bc", "", "done", "stop", "", '["s"]'),
    2: (fold.STREAM_ERROR, "why", "error", "stream_error", "", "[]"),
    3: ("open", "", "done", "stop", "", "[]"),
    4: ("no net", "", "error", "network_error", "", "[]"),
}


def facts(rows):
    return {r.stream_id: (r.answer, r.reasoning, r.status, r.finish_reason, r.rag_note, r.rag_sources) for r in rows}


def test_batch_fold(spark):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    assert facts(fold.fold_batch(df).collect()) == WANT


def run_stream(spark, tmp_path, parts, **options):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = (
        fold.fold_stream(live, **options).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return fold.latest_turns(spark.read.schema(fold.OUTPUT).parquet(out))


def test_stream_fold_with_replay(spark, tmp_path):
    parts = [[e for e in EVENTS if e[1] <= 2], [e for e in EVENTS if e[1] in (2, 3)], [e for e in EVENTS if e[1] > 3]]
    assert facts(fold.close_open_turns(run_stream(spark, tmp_path, parts)).collect()) == WANT


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_fold_of_any_split(spark, tmp_path, seed):
    """Events out of order, dealt at random, some twice, with a number that never comes."""
    dice = random.Random(seed)
    more = [(5, n, "token", f"{n} ", None, None, None) for n in range(1, 30) if n != 17]
    parts = [[] for _ in range(4)]
    for e in EVENTS + more:
        for _ in range(dice.choice((1, 1, 2))):
            dice.choice(parts).append(e)
    got = facts(fold.close_open_turns(run_stream(spark, tmp_path, [p for p in parts if p])).collect())
    assert got == WANT | {5: ("".join(e[3] for e in more), "", "done", "stop", "", "[]")}
    assert got == facts(fold.fold_batch(spark.createDataFrame([e for p in parts for e in p], SCHEMA)).collect())


def test_packets(spark):
    body = 'event: token\r\ndata: {"text":\r\ndata: "a"}\r\n\r\n: ping\n\nevent: x\nevent: done\ndata: {}\n\ndata: {bad\n\nevent: token\ndata: {"text":"cut"}'
    df = spark.createDataFrame([(1, body)], "stream_id int, body string")
    got = packets.typed_events(packets.parse_packets(packets.split_bodies(df))).orderBy("seq").collect()
    assert [(r.event, r.text) for r in got] == [("token", "a"), ("done", None)]


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_batch_fold_in_blocks(spark, block):
    df = spark.createDataFrame(EVENTS + EVENTS[:4], SCHEMA)
    assert facts(fold.fold_batch(df, block).collect()) == WANT


def stream_of(spark, path, batches, schema):
    """A stream that reads one frame a batch, in turn."""
    for i, rows in enumerate(batches):
        where = f"{path}/{i:03d}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(where)
        for file in os.listdir(where):
            if file.endswith(".parquet"):
                os.utime(f"{where}/{file}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def updates_of(spark, frame, mode):
    """The rows of every batch."""
    seen = {}

    def write(batch, i):
        seen.setdefault(i, []).extend(batch.collect())

    stream_queries.run_to_end(spark, frame, mode, write)
    return [row for i in sorted(seen) for row in seen[i]]


EVENT = "scope string, kind string, request_id bigint, seq bigint, body string"


def test_latest_request_on_a_stream(spark, tmp_path):
    batches = [
        [("a", "request", 1, 1, None), ("a", "answer", 1, None, "old"), ("b", "answer", 7, None, "early"), ("c", "request", 1, 5, None)],
        [("a", "request", 2, 2, None), ("a", "answer", 1, None, "too late"), ("b", "request", 7, 3, None), ("c", "request", 9, 5, None)],
        [("a", "answer", 2, None, "new"), ("a", "answer", 2, None, "new too"), ("b", "request", 6, 2, None), ("c", "answer", 1, None, "lost")],
        [("b", "answer", 6, None, "superseded"), ("d", "answer", 1, None, "no request")],
    ]
    found = updates_of(spark, requests.latest_requests_stream(stream_of(spark, str(tmp_path), batches, EVENT), None), "update")
    told = [(r.scope, r.request_id, r.body) for r in found if r.answered]
    assert sorted(told) == [("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new too"), ("b", 7, "early")]
    shape = "scope string, request_id bigint, seq bigint, body string, answered boolean"
    last = requests.settled(spark.createDataFrame(found, shape)).collect()
    assert sorted((r.scope, r.body) for r in last) == [("a", "new"), ("a", "new too"), ("b", "early")]  # c: the newest request has no answer


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_latest_request_in_any_order(spark, tmp_path, seed):
    """The stream settles on what the batch job gives, whatever comes first."""
    dice = random.Random(seed)
    asked = [(s, "request", 10 * k + i, k, None) for i, s in enumerate("abcd") for k in range(6)]
    told = [(s, "answer", q, k if dice.random() < 0.5 else None, f"{s}{q}") for s, _, q, k, _ in asked if dice.random() < 0.8]
    rows = asked + told
    dice.shuffle(rows)
    batches = [b for b in (rows[i::4] for i in range(4)) if b]
    found = updates_of(spark, requests.latest_requests_stream(stream_of(spark, str(tmp_path), batches, EVENT), None), "update")
    shape = "scope string, request_id bigint, seq bigint, body string, answered boolean"
    last = {(r.scope, r.request_id, r.body) for r in requests.settled(spark.createDataFrame(found, shape)).collect()}
    both = spark.createDataFrame(rows, EVENT)
    want = debounce.latest_requests(both.where("kind = 'answer'").drop("kind", "seq"), both.where("kind = 'request'").drop("kind", "body"))
    assert last == {(r.scope, r.request_id, r.body) for r in want.collect()}


def test_superseded_rows_leave_before_the_shuffle():
    schema = pa.schema([("scope", pa.string()), ("kind", pa.string()), ("seq", pa.int64())])
    batch = pa.RecordBatch.from_pylist([{"scope": "a", "kind": "request", "seq": k} for k in range(5)] + [{"scope": "a", "kind": "answer", "seq": s} for s in (3, 4, None)], schema)
    (left,) = requests.drop_superseded([batch])
    assert left.column("seq").to_pylist() == [4, 4, None]


def test_early_answers_expire(spark):
    """An answer whose request does not come is dropped by the timer; one that still may be met stays."""

    class Value:
        def __init__(self):
            self.v = None

        exists = lambda self: self.v is not None
        get = lambda self: self.v

        def update(self, v):
            self.v = v

    class Map(dict):
        containsKey, getValue, updateValue = dict.__contains__, dict.get, dict.__setitem__
        iterator = dict.items

        def removeKey(self, k):
            self.pop(k, None)

    class Handle:
        def __init__(self):
            self.timers = []

        getValueState = lambda self, *a: Value()
        getMapState = lambda self, *a: Map()

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def __init__(self, ms):
            self.getCurrentProcessingTimeInMs = lambda: ms

    handle, state = Handle(), requests.NewestRequest("bigint", 100)
    state.init(handle)
    frame = lambda q: pd.DataFrame({"kind": ["answer"], "request_id": [q], "numbered": [False], "seq": [0], "body": ["x"]})
    assert not list(state.handleInputRows(("a",), iter([frame(1)]), Now(0))) and handle.timers == [100]
    assert not list(state.handleInputRows(("a",), iter([frame(2)]), Now(60))) and handle.timers == [100]
    handle.timers.clear()
    assert not list(state.handleExpiredTimer(("a",), Now(100), None)) and handle.timers == [160] and list(state._early) == [(2,)]


@pytest.mark.parametrize("rows_a_batch", [1, 7, 400])
def test_early_answers_wait_in_chunks(monkeypatch, rows_a_batch):
    """A batch of answers costs a few calls of the state store, and every answer comes out once its request is the newest."""
    calls = []

    class Value:
        v = None
        get = lambda self: self.v

        def update(self, v):
            self.v = v

    class Map(dict):
        getValue, removeKey = dict.get, dict.pop

        def updateValue(self, k, v):
            calls.append(k)
            self[k] = v

    class Handle:
        getValueState = lambda self, *a: Value()
        getMapState = lambda self, *a: Map()

    def run(rows):
        frame = pd.DataFrame(rows, columns=["kind", "request_id", "numbered", "seq", "body"])
        return [(r.request_id, r.body) for out in state.handleInputRows(("a",), iter([frame]), None) for r in out.itertuples() if r.answered]

    monkeypatch.setattr(requests, "CHUNK", 64)
    state, dice = requests.NewestRequest("bigint", None), random.Random(rows_a_batch)
    state.init(Handle())
    answers = [("answer", q, False, 0, f"{q}/{i}") for q in range(400) for i in range(1 + q % 3)]
    dice.shuffle(answers)
    batches = [answers[i : i + rows_a_batch] for i in range(0, len(answers), rows_a_batch)]
    for batch in batches:
        assert not run(batch)
    assert len(calls) <= len(batches) + len(answers) // 32 and len(state._early) <= 8 + len(answers) // 16
    for q in range(400):
        assert sorted(run([("request", q, True, q, None)])) == [(q, f"{q}/{i}") for i in range(1 + q % 3)]
    assert not state._early


BODY = 'event: meta\r\ndata: {"rag_note":"né€"}\r\n\r\n: ping\n\n\n\nevent: token\ndata: {"text":\ndata: "😀"}\n\ndata: {bad\n\nevent: done\ndata: {}\r\n\r\nevent: token\ndata: {"text":"cut"}'


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bodies_cut_at_any_byte(spark, tmp_path, seed):
    """Pieces out of order, some twice; characters and line ends are cut too. All give the packets of the whole body."""
    dice, schema = random.Random(seed), "stream_id bigint, piece bigint, body binary"
    rows, bodies = [], {}
    for stream in range(5):
        body = (BODY * dice.randint(1, 3)).encode() + (b"\xff\n\n" if stream == 4 else b"")
        bodies[stream] = body
        cuts = sorted({0, len(body), *(dice.randrange(len(body)) for _ in range(dice.choice([0, 3, 60])))})
        pieces = [(stream, i, body[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        rows += pieces + [p for p in pieces if dice.random() < 0.3]
    dice.shuffle(rows)
    found = updates_of(spark, packets.cut_pieces(stream_of(spark, str(tmp_path), [b for b in (rows[i::3] for i in range(3)) if b], schema)), "append")
    for stream, body in bodies.items():
        whole = [p.strip() for p in body.decode(errors="replace").replace("\r", "").split("\n\n")[:-1]]
        got = sorted((r.seq, r.packet) for r in found if r.stream_id == stream)
        assert got == list(enumerate([p for p in whole if p], 1))


def test_kept_numbers_leave_no_gap(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(["data: {}", ": ping", "data: {bad", "event: done\ndata: {}"])], "stream_id int, seq int, packet string")
    kept = packets.parse_packets(df, keep_numbers=True).orderBy("seq").collect()
    assert [(r.seq, r.event) for r in kept] == [(0, "message"), (1, None), (2, None), (3, "done")]


ROW = "scope string, id string, title string, digest string, status string, finish_reason string, rag_note string, source_count bigint, turn_count bigint, created_s bigint, updated_s bigint"
STORED = ROW + ", fingerprint string"


def version(scope, i, title, at, note=None):
    return scope, i, title, "d", "done", "stop", note, None, 1, at, at


def test_only_changes_pass(spark, tmp_path):
    batches = [
        [version("s", "1", "a", 1), version("s", "1", "b", 3), version("s", "2", "x", 1)],
        [version("s", "1", "b", 4), version("s", "1", "a", 2), version("s", "2", "x", 5, "note")],  # the same, an old one, another note
        [version("s", "1", "c", 9), version(None, "1", "c", 9), version("s", None, "c", 9)],
    ]
    found = updates_of(spark, sink.changed_stream(stream_of(spark, str(tmp_path), batches, ROW)), "update")
    assert [(r.id, r.title, r.updated_s, r.rag_note) for r in sorted(found, key=lambda r: (r.updated_s, r.id))] == [
        ("2", "x", 1, None), ("1", "b", 3, None), ("2", "x", 5, "note"), ("1", "c", 9, None)]


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_writer_touches_only_changed_buckets(spark, tmp_path):
    path = str(tmp_path / "sessions")
    write = sink.session_writer(path, STORED, buckets=8, keep=2)
    batch = lambda *rows: spark.createDataFrame(rows, ROW)
    table = lambda: sorted((r.scope, r.id, r.title, r.created_s, r.updated_s) for r in sink.read_sessions(spark, path, STORED).collect())
    assert table() == []
    write(batch(*[version(f"s{k}", "1", "a", 1) for k in range(20)]), 0)
    before, first = files_of(path), table()
    assert len(first) == 20 and len(before) <= 8
    write(batch(version("s3", "1", "a", 7)), 1)  # the same content: no file is written
    write(batch(), 2)
    assert files_of(path) == before and table() == first
    write(batch(version("s3", "1", "b", 8)), 3)
    after = files_of(path)
    assert len(before - after) == 1 and ("s3", "1", "b", 1, 8) in table()
    write(batch(version("s3", "1", "b", 8)), 3)  # the batch again: nothing changes
    assert files_of(path) == after
    write(batch(version("s3", "1", "a", 2)), 4)  # older than what is stored
    assert files_of(path) == after
    write(batch(version("s3", "2", "n", 9), version("s3", "3", "n", 10)), 5)  # the cap leaves the newest two
    assert [r[1] for r in table() if r[0] == "s3"] == ["2", "3"]


def test_interrupted_write_is_finished(spark, tmp_path):
    """New content that was complete beside the table is put in its place; what was not complete is written anew."""
    path = str(tmp_path / "sessions")
    write = sink.session_writer(path, STORED, buckets=4)
    write(spark.createDataFrame([version("a", "1", "old", 1)], ROW), 0)
    stored = buckets.read_buckets(spark, path, STORED)
    stored.withColumn("title", F.lit("new")).write.parquet(f"{path}_next")
    for file in files_of(path):
        os.remove(file)  # the copy had begun
    assert [r.title for r in sink.read_sessions(spark, path, STORED).collect()] == ["new"] and not os.path.exists(f"{path}_next")
    stored = buckets.read_buckets(spark, path, STORED)
    stored.withColumn("title", F.lit("cut off")).write.parquet(f"{path}_next")
    os.remove(f"{path}_next/_SUCCESS")  # this one was not complete
    write(spark.createDataFrame([version("a", "1", "newer", 5)], ROW), 1)
    assert [r.title for r in sink.read_sessions(spark, path, STORED).collect()] == ["newer"]


@pytest.mark.parametrize("gap,periods", [("250 milliseconds", 3), ("1 second", 2)])
def test_debounce(spark, gap, periods):
    from docketry.streaming.debounce import debounced

    rows = [(1, 0.0, 1, "a"), (1, 0.2, 2, "b"), (1, 0.9, 3, "c"), (1, 5.0, 4, "d")]
    df = spark.createDataFrame(rows, "scope int, t double, seq int, notes string").withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("bigint")))
    got = debounced(df, "notes", gap).orderBy("seq").collect()
    assert len(got) == periods and [r.notes for r in got][-2:] == ["c", "d"]


def test_waiting_rows_share_state_calls():
    """A batch ahead of its turn is one call of the state for each chunk; a chunk that holds what comes next is read once."""
    from docketry.streaming.waiting import CHUNK, Waiting

    calls = []

    class Map(dict):
        def updateValue(self, k, v):
            calls.append(k)
            self[k] = v

        getValue, removeKey = dict.__getitem__, dict.__delitem__

    state = Map()
    waiting = Waiting(state)
    waiting.close({n: f"x{n}" for n in range(5, 5 + CHUNK + 1)})
    assert len(calls) == 2 and len(waiting) == 2
    again = Waiting(state, *waiting.directory())
    assert again.open(4) == {} and len(again.open(5)) == CHUNK
    again.close({n: f"x{n}" for n in range(7, 5 + CHUNK)})
    assert len(calls) == 3 and sorted(n for v in state.values() for n in v[0]) == list(range(7, 5 + CHUNK + 1))


def test_streams_of_a_group_share_calls(monkeypatch):
    """The new rows of many streams are one call of the processor, each stream with one read and one write of its state."""
    import pandas as pd

    class Map(dict):
        def getValue(self, k):
            return self[k]

        def updateValue(self, k, v):
            calls.append(k)
            self[k] = v

        removeKey = dict.__delitem__

        def containsKey(self, k):
            return k in self

        def exists(self):
            return bool(self)

    class Handle:
        def __init__(self):
            self.maps = {}

        def getMapState(self, name, *_):
            return self.maps.setdefault(name, Map())

    calls, handle = [], Handle()
    one = fold.TurnFolds(1)
    one.init(handle)
    columns = ["stream", "seq", "event", "text", "note", "reason", "sources"]

    def run(rows):
        frames = [pd.DataFrame([(*r, None, None, None) for r in rows[i::2]], columns=columns) for i in range(2)]
        return {r.stream: (r.answer, r.status, r.last_seq) for f in one.handleInputRows((7,), iter(frames), None) for r in f.itertuples()}

    rows = [(s, n, "token", f"{s}{n} ") for n in (4, 1, 2) for s in ("a", "b", None)]
    want = {s: (f"{s}1 {s}2 {s}4 ", "streaming", 4) for s in ("a", "b", None)}
    assert run(rows) == want
    assert len(calls) == 6 and len(handle.maps["later"]) == 3
    assert run([("a", 3, "token", "a3 "), ("a", 5, "done", None), ("a", 2, "token", "again")]) == {"a": ("a1 a2 a3 a4 ", "done", 5)}
    assert len(handle.maps["later"]) == 2 and set(handle.maps["turn"]) == {("a",), ("b",), (None,)}
    cutter = packets.PacketCutter(0)
    handle = Handle()
    cutter.init(handle)
    pieces = pd.DataFrame([("x", 1, b"o\n\ntwo\n"), ("y", 0, b"one\n\n"), ("x", 0, b"tw")], columns=["stream", "piece", "body"])
    assert [f.values.tolist() for f in cutter.handleInputRows((3,), iter([pieces]), None)] == [[["x", 1, "two"], ["y", 1, "one"]]]
    assert handle.maps["at"][("x",)][2] == b"two\n"
