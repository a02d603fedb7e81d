"""ST6 on a stream: of every scope only the answers to its newest request, whatever the batches are.

Requests and answers come in one input (``tagged``), in any order. State of a scope: its newest request, and the answers
that came before a request they could belong to. An answer to an older request is dropped; an answer ahead of its
request waits for it, ``wait_ms`` at most. Spark ends no stream that has processing timers, so a bounded run gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WAIT_MS = 600_000
REQUEST, ANSWER = "request", "answer"
#: Answers that wait in one chunk at most, and the characters of their bodies from which it is full; more only for one request.
CHUNK, CHUNK_CHARS = 4096, 1 << 20
DIRECTORY = "firsts array<{0}>, lasts array<{0}>, sizes array<bigint>"


def tagged(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """One input of ``requests`` (scope, request_id, seq) and ``answers`` (scope, request_id, body, and seq if known).

    Rows without scope or request, and requests without a number, belong to nothing and are dropped.
    """
    seq = F.col("seq") if "seq" in answers.columns else F.lit(None)
    asked = requests.select("scope", F.lit(REQUEST).alias("kind"), "request_id", F.col("seq").cast("bigint").alias("seq"), F.lit(None).cast("string").alias("body"))
    told = answers.select("scope", F.lit(ANSWER).alias("kind"), "request_id", seq.cast("bigint").alias("seq"), F.col("body").cast("string").alias("body"))
    both = asked.where(F.col("seq").isNotNull()).unionByName(told)
    return both.where(F.col("scope").isNotNull() & F.col("request_id").isNotNull())


def drop_superseded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leave out rows that a newer request of their scope in the same Arrow batch supersedes.

    Runs before the shuffle, so that a scope with a large share of all requests sends few of them to its task.
    """
    for batch in batches:
        asked = pa.Table.from_batches([batch.filter(pc.equal(batch.column("kind"), REQUEST))])
        newest = asked.group_by("scope").aggregate([("seq", "max")])
        top = newest.column("seq_max").combine_chunks().take(pc.index_in(batch.column("scope"), value_set=newest.column("scope").combine_chunks()))
        seq = batch.column("seq")
        old = pc.fill_null(pc.less(seq, top), False)
        yield batch.filter(pc.invert(old))


class NewestRequest(StatefulProcessor):
    """State of one scope.

    A call to the state store costs far more than a row does. So answers wait in chunks, sorted by request, and one value holds the
    newest request and the directory of the chunks: first and last request, number of answers. A chunk's key is its last request.
    Chunks no larger than what a batch adds are written anew with it, so few small ones stay.
    """

    def __init__(self, id_type: str, wait_ms: int | None):
        self._id_type, self._wait_ms = id_type, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._scope = handle.getValueState("scope", f"seq bigint, request_id {self._id_type}, {DIRECTORY.format(self._id_type)}")
        self._early = handle.getMapState("early", f"request_id {self._id_type}", f"requests array<{self._id_type}>, bodies array<string>, came_ms array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, chunks = self._load()
        newest, now, fresh = before, timerValues.getCurrentProcessingTimeInMs() if self._wait_ms else 0, []
        for frame in rows:
            for kind, request, numbered, seq, body in frame[["kind", "request_id", "numbered", "seq", "body"]].itertuples(index=False, name=None):
                request, seq = _plain(request), int(seq) if numbered else None
                if kind == REQUEST:
                    newest = (seq, request) if newest is None else max(newest, (seq, request))
                elif seq is None or newest is None or (seq, request) >= newest:
                    fresh.append((request, body, now))
        told, held_before, changed = [], bool(chunks), bool(fresh)
        if newest is not None:
            for last in [k for k, (first, _) in chunks.items() if first <= newest[1] <= k]:
                items = self._items(last)
                mine = [body for request, body, _ in items if request == newest[1]]
                if mine:
                    told, changed = told + mine, True
                    fresh = [x for x in items if x[0] != newest[1]] + fresh
                    self._drop(chunks, last)
            told += [body for request, body, _ in fresh if request == newest[1]]
            fresh = [x for x in fresh if x[0] != newest[1]]
        if fresh:
            self._add(chunks, fresh)
        if self._wait_ms and chunks and not held_before:
            self._handle.registerTimer(now + self._wait_ms)
        if changed or newest != before:
            self._store(newest, chunks)
        bodies = ([None] if newest != before else []) + told
        if bodies:
            answered = [False] * (newest != before) + [True] * len(told)
            n = len(bodies)
            yield pd.DataFrame({"scope": [key[0]] * n, "request_id": [newest[1]] * n, "seq": [newest[0]] * n, "body": pd.Series(bodies, dtype=object), "answered": answered})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Answers that have waited long enough, counted from the last one to their request, go; the timer is set again for the others."""
        now, came = timerValues.getCurrentProcessingTimeInMs(), {}
        newest, chunks = self._load()
        waiting = {last: self._items(last) for last in chunks}
        for items in waiting.values():
            for request, _, at in items:
                came[request] = max(at, came.get(request, at))
        gone = {request for request, at in came.items() if at + self._wait_ms <= now}
        left = []
        for last, items in waiting.items():
            if any(x[0] in gone for x in items):
                left += [x for x in items if x[0] not in gone]
                self._drop(chunks, last)
        if left:
            self._add(chunks, left)
        if len(gone) < len(came):
            self._handle.registerTimer(min(at for request, at in came.items() if request not in gone) + self._wait_ms)
        self._store(newest, chunks)
        yield from ()

    def close(self) -> None:
        pass

    def _load(self) -> tuple[tuple | None, dict]:
        """The newest request, and (first request, answers) of every chunk by its last request, in the order they were written."""
        found = self._scope.get()
        if found is None:
            return None, {}
        seq, request, firsts, lasts, sizes = found
        return (None if seq is None else (seq, request)), dict(zip(lasts, zip(firsts, sizes, strict=True), strict=True))

    def _store(self, newest: tuple | None, chunks: dict) -> None:
        self._scope.update((*(newest or (None, None)), [first for first, _ in chunks.values()], list(chunks), [n for _, n in chunks.values()]))

    def _items(self, last) -> list[tuple]:
        return list(zip(*self._early.getValue((last,)), strict=True))

    def _drop(self, chunks: dict, last) -> None:
        self._early.removeKey((last,))
        del chunks[last]

    def _add(self, chunks: dict, fresh: list[tuple]) -> None:
        """Store ``fresh`` answers, together with the newest chunks that are no larger, and with any whose key one of them bears."""
        while chunks:
            last, (_, n) = next(reversed(chunks.items()))
            if n > min(len(fresh), CHUNK - 1):
                break
            fresh = self._items(last) + fresh
            self._drop(chunks, last)
        while same := chunks.keys() & {x[0] for x in fresh}:
            for last in [k for k in chunks if k in same][::-1]:
                fresh = self._items(last) + fresh
                self._drop(chunks, last)
        self._write(chunks, sorted(fresh, key=lambda x: x[0]))

    def _write(self, chunks: dict, items: list[tuple]) -> None:
        """Cut sorted answers into chunks; those of one request stay together."""
        start, size = 0, 0
        for i, (request, body, _) in enumerate(items):
            size += len(body or "")
            if i + 1 == len(items) or (i + 1 - start >= CHUNK or size >= CHUNK_CHARS) and items[i + 1][0] != request:
                part = items[start : i + 1]
                self._early.updateValue((request,), tuple(map(list, zip(*part, strict=True))))
                chunks[request] = (part[0][0], len(part))
                start, size = i + 1, 0


def _plain(value):
    """A numpy number as a Python one."""
    return value.item() if hasattr(value, "item") else value


def latest_requests_stream(events: DataFrame, wait_ms: int | None = WAIT_MS) -> DataFrame:
    """ST6: updates (scope, request_id, seq, body, answered) of a stream of ``tagged`` rows, update mode, RocksDB.

    Without ``wait_ms`` an answer waits for its request as long as the stream lives.

    A scope gives a row without an answer when its newest request changes, and a row for every answer to it. Of equal
    numbers the larger request id is newer.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    shape = f"scope {types['scope']}, request_id {types['request_id']}, seq bigint, body string, answered boolean"
    fewer = events.mapInArrow(drop_superseded, events.schema)
    # pandas would turn numbers with NULLs among them into floating point
    rows = fewer.withColumns({"numbered": F.col("seq").isNotNull(), "seq": F.coalesce("seq", F.lit(0))})
    return rows.groupBy("scope").transformWithStateInPandas(
        statefulProcessor=NewestRequest(types["request_id"], wait_ms), outputStructType=shape, outputMode="update", timeMode="ProcessingTime" if wait_ms else "none"
    )


def settled(updates: DataFrame) -> DataFrame:
    """The answers to the newest request of every scope, from all updates so far; none while it has no answer."""
    newest = updates.groupBy("scope").agg(F.max(F.struct("seq", "request_id")).alias("_n"))
    newest = newest.select("scope", F.col("_n.seq").alias("seq"), F.col("_n.request_id").alias("request_id"))
    return updates.where("answered").join(newest, ["scope", "seq", "request_id"], "left_semi").select("scope", "request_id", "seq", "body")
