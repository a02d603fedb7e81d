"""ST2 + ST3: token events folded into turns, as a batch job and as a stateful stream.

Events: stream_id, seq, event, text, note, reason, sources. Both forms give one row per stream:
answer, reasoning, status, finish_reason, rag_note, rag_sources.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docketry.operators.blocks import TEXT_BLOCK
from docketry.streaming.waiting import DIRECTORY, OfStream, Waiting, by_stream, group_of, stored

# Fixed value: shown when an error event carries no detail.
STREAM_ERROR = "Une erreur est survenue pendant le streaming."
OUTPUT = (
    "stream_id bigint, answer string, reasoning string, status string, finish_reason string, "
    "rag_note string, rag_sources string, last_seq bigint, n_events bigint"
)
STATE = (
    "answer string, reasoning string, status string, finish_reason string, rag_note string, "
    f"rag_sources string, last_seq bigint, n_events bigint, applied bigint, {DIRECTORY}"
)
EVENT = "event string, text string, note string, reason string, sources string"
WAITING = f"numbers array<bigint>, events array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")[1:]]
KNOWN = ("meta", "token", "reasoning", "replace", "done", "error")
EVENT_COLUMNS = ("note", "reason", "sources")


def _complete(events: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in EVENT_COLUMNS if c not in events.columns}
    return events.withColumns(missing) if missing else events


def _nth(items, n: int = 0):
    return F.get(items, F.lit(n))


def _seqs(items):
    return F.transform(items, lambda x: x["seq"])


def _part_of_block(rows: DataFrame) -> DataFrame:
    """The fold of the events ``_ev`` (sorted) of one block: what it adds, and what it overrides."""
    by_name = lambda name: lambda x: x["event"] == name
    terminal = lambda x: x["event"].isin("done", "error")
    once = lambda x, i: (i == 0) | (F.get("_ev", i - 1)["seq"] != x["seq"])
    cut = rows.withColumn("_once", F.filter("_ev", once)).withColumn("_stop", _nth(F.filter("_once", terminal)))
    end = F.col("_stop.seq")
    live = cut.withColumn("_live", F.filter("_once", lambda x: end.isNull() | (x["seq"] <= end)))
    based = live.withColumn("_base", _nth(F.reverse(F.filter("_live", lambda x: by_name("replace")(x) & x["text"].isNotNull()))))
    base = F.col("_base.seq")
    texts = lambda keep: F.array_join(F.transform(F.filter("_live", keep), lambda x: x["text"]), "")
    return based.select(
        "stream_id",
        F.struct(
            F.col("_blk").alias("blk"),
            F.col("_stop").alias("stop"),
            F.col("_base.text").alias("base"),
            texts(lambda x: by_name("token")(x) & (base.isNull() | (x["seq"] > base))).alias("tail"),
            texts(by_name("reasoning")).alias("thoughts"),
            _nth(F.reverse(F.filter("_live", by_name("meta")))).alias("meta"),
            F.array_max(_seqs(F.col("_live"))).alias("last_seq"),
        ).alias("_part"),
    )


def fold_batch(events: DataFrame, block: int = TEXT_BLOCK) -> DataFrame:
    """Fold finished streams; a replayed number counts once.

    The fold of a stretch of events can be folded again: a stretch adds text, or overrides what came before (replace),
    or ends the turn. So events are folded block by block of their numbers, and a stream collects one part for each block.
    Two shuffles, no join.
    """
    e = _complete(events).where(F.col("event").isin(*KNOWN)).withColumn("_blk", F.floor(F.col("seq") / block).cast("bigint"))
    cells = F.struct("seq", "event", "text", *EVENT_COLUMNS)
    blocks = e.groupBy("stream_id", "_blk").agg(F.array_sort(F.collect_list(cells)).alias("_ev"))
    parts = _part_of_block(blocks).groupBy("stream_id").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    cut = parts.withColumn("_stop", _nth(F.filter("_parts", lambda x: x["stop"].isNotNull())))
    end = F.col("_stop.blk")
    live = cut.withColumn("_live", F.filter("_parts", lambda x: end.isNull() | (x["blk"] <= end)))
    based = live.withColumn("_base", _nth(F.reverse(F.filter("_live", lambda x: x["base"].isNotNull()))))
    base = F.col("_base.blk")
    rows = based.select(
        "stream_id",
        F.col("_stop.stop").alias("_last"),
        F.col("_base.base").alias("_text"),
        F.array_join(F.transform(F.filter("_live", lambda x: base.isNull() | (x["blk"] >= base)), lambda x: x["tail"]), "").alias("_tail"),
        F.array_join(F.transform("_live", lambda x: x["thoughts"]), "").alias("_thoughts"),
        _nth(F.reverse(F.filter(F.transform("_live", lambda x: x["meta"]), lambda x: x.isNotNull()))).alias("_meta"),
        F.array_max(F.transform("_live", lambda x: x["last_seq"])).alias("last_seq"),
    )
    last, failed, done = F.col("_last"), F.col("_last.event") == "error", F.col("_last.event") == "done"
    blank = F.lit("")
    answer = F.concat(F.coalesce("_text", blank), "_tail")
    return rows.select(
        "stream_id",
        F.when(failed, F.coalesce(last["text"], F.lit(STREAM_ERROR))).otherwise(answer).alias("answer"),
        F.col("_thoughts").alias("reasoning"),
        F.when(failed, "error").otherwise("done").alias("status"),
        F.when(failed, F.coalesce(last["reason"], F.lit("stream_error"))).otherwise(F.coalesce(last["reason"], F.lit("stop"))).alias("finish_reason"),
        F.when(done, F.coalesce(last["note"], blank)).otherwise(F.coalesce(F.col("_meta.note"), blank)).alias("rag_note"),
        F.coalesce(F.when(done, last["sources"]), F.col("_meta.sources"), F.lit("[]")).alias("rag_sources"),
        "last_seq",
    )


@dataclasses.dataclass
class Turn:
    """A turn so far. ``applied``: every event up to this number is in it."""

    answer: list[str]
    reasoning: list[str]
    status: str = "streaming"
    finish_reason: str = ""
    rag_note: str = ""
    rag_sources: str = "[]"
    last_seq: int = -1
    n_events: int = 0
    applied: int = 0

    @classmethod
    def of(cls, answer: str, reasoning: str, *rest) -> Turn:
        return cls([answer], [reasoning], *rest)

    def values(self) -> tuple:
        """The row of ``STATE`` without the directory; its first members are those of ``OUTPUT``."""
        rest = [getattr(self, f.name) for f in dataclasses.fields(self)[2:]]
        return "".join(self.answer), "".join(self.reasoning), *rest

    def apply(self, seq: int, event: tuple) -> None:
        name, value, note, reason, sources = event
        if name not in KNOWN:
            return
        self.last_seq = seq
        if name == "token":
            self.answer.append(value or "")
        elif name == "reasoning":
            self.reasoning.append(value or "")
        elif name == "replace":
            self.answer = self.answer if value is None else [value]
        elif name == "meta":
            self.rag_note, self.rag_sources = note or "", "[]" if sources is None else sources
        elif name == "done":
            self.status, self.finish_reason, self.rag_note = "done", "stop" if reason is None else reason, note or ""
            self.rag_sources = self.rag_sources if sources is None else sources
        else:
            self.status, self.finish_reason = "error", "stream_error" if reason is None else reason
            self.answer = [STREAM_ERROR if value is None else value]

    @property
    def is_open(self) -> bool:
        return self.status == "streaming"


class TurnFold(StatefulProcessor):
    """State of one stream: the turn up to the first gap, and the events beyond it by number.

    The turn given out holds all events seen so far in the order of their numbers, however they were
    dealt over the batches. Replays, and events after the end, are ignored. With a positive
    ``idle_ms`` a stream without new events for that long is closed as finished, gaps or not.
    """

    def __init__(self, first_seq: int, ttl_ms: int | None = None, idle_ms: int | None = None):
        self._first_seq, self._ttl_ms, self._idle_ms = first_seq, ttl_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._turn = handle.getValueState("turn", STATE, self._ttl_ms)
        self._later = handle.getMapState("later", "chunk bigint", WAITING, self._ttl_ms)

    def _stored(self) -> tuple[Turn, Waiting]:
        *turn, ids, starts = self._turn.get()
        return Turn.of(*turn), Waiting(self._later, ids, starts)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn, waiting = self._stored() if self._turn.exists() else (Turn([], [], applied=self._first_seq - 1), Waiting(self._later))
        later = waiting.open()
        for frame in rows:
            self._take(turn, later, frame[["seq", "event", "text", *EVENT_COLUMNS]].itertuples(index=False, name=None))
        self._settle(turn, waiting, later)
        self._turn.update((*turn.values(), *waiting.directory()))
        if self._idle_ms and turn.is_open:
            for old in list(self._handle.listTimers()):
                self._handle.deleteTimer(old)
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle_ms)
        yield self._row(key, self._with_later(turn, later))

    @staticmethod
    def _take(turn: Turn, later: dict[int, tuple], rows: Iterable) -> None:
        """Apply what follows the turn without a gap; keep the rest by number."""
        for seq, *event in sorted(rows, key=itemgetter(0)):
            seq, event = int(seq), tuple(x if isinstance(x, str) else None for x in event)
            if not turn.is_open:
                return
            if seq <= turn.applied or seq in later:
                continue
            turn.n_events += 1
            if seq == turn.applied + 1:
                turn.applied = seq
                turn.apply(seq, event)
            else:
                later[seq] = event

    @staticmethod
    def _settle(turn: Turn, waiting: Waiting, later: dict[int, tuple]) -> None:
        """Apply what waits no longer and store what does."""
        while turn.is_open and turn.applied + 1 in later:
            turn.applied += 1
            turn.apply(turn.applied, tuple(later.pop(turn.applied)))
        if turn.is_open:
            waiting.close(later)
        elif len(waiting):
            waiting.clear()

    @staticmethod
    def _with_later(turn: Turn, later: dict[int, tuple]) -> Turn:
        """The turn with the events beyond its gaps."""
        if not (later and turn.is_open):
            return turn
        shown = Turn.of(*turn.values())
        for seq in sorted(later):
            if not shown.is_open:
                break
            shown.apply(seq, tuple(later[seq]))
        return shown

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """ST3: the input ended without a terminal event."""
        if self._turn.exists():
            turn, waiting = self._stored()
            if turn.is_open:
                turn = self._with_later(turn, waiting.open())
                if turn.is_open:
                    turn.status, turn.finish_reason = "done", "stop"
                waiting.clear()
                self._turn.update((*turn.values(), *waiting.directory()))
                yield self._row(key, turn)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, turn: Turn) -> pd.DataFrame:
        return pd.DataFrame({"stream_id": [key[0]], **{n: [v] for n, v in zip(NAMES, turn.values(), strict=False)}})


class TurnFolds(TurnFold):
    """``TurnFold`` for streams that come in groups; without timers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._turn = handle.getMapState("turn", "stream string", STATE, self._ttl_ms)
        self._later = handle.getMapState("later", "stream string, chunk bigint", WAITING, self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = by_stream(rows, ["seq", "event", "text", *EVENT_COLUMNS])
        out = []
        for stream, at in stored(self._turn, new):
            *held, ids, starts = at or ((), ())
            turn = Turn.of(*held) if held else Turn([], [], applied=self._first_seq - 1)
            waiting = Waiting(OfStream(self._later, stream), ids, starts)
            later = waiting.open()
            self._take(turn, later, new.pop(stream))
            self._settle(turn, waiting, later)
            self._turn.updateValue((stream,), (*turn.values(), *waiting.directory()))
            out.append((stream, *self._with_later(turn, later).values()[: len(NAMES)]))
        yield pd.DataFrame(out, columns=["stream", *NAMES])


def fold_stream(events: DataFrame, ttl_ms: int | None = None, idle_ms: int | None = None, first_seq: int = 1) -> DataFrame:
    """The stateful form; needs the RocksDB state store. Emits the turn after every batch (update).

    Events of a stream are numbered from ``first_seq`` on, usually without holes; a hole only keeps
    the events after it in the state one by one. Streams are folded in groups; with ``idle_ms`` each has timers and calls of its own.
    """
    columns = ["seq", "event", "text", *EVENT_COLUMNS]
    if idle_ms:
        rows, one = _complete(events).select("stream_id", *columns).groupBy("stream_id"), TurnFold(first_seq, ttl_ms, idle_ms)
        return rows.transformWithStateInPandas(statefulProcessor=one, outputStructType=OUTPUT, outputMode="update", timeMode="ProcessingTime")
    # the name of a stream travels as text: pandas has no whole numbers with NULLs among them
    rows = _complete(events).select(group_of("stream_id"), F.col("stream_id").cast("string").alias("stream"), *columns)
    turns = rows.groupBy("group").transformWithStateInPandas(
        statefulProcessor=TurnFolds(first_seq, ttl_ms),
        outputStructType=OUTPUT.replace("stream_id bigint", "stream string"),
        outputMode="update",
        timeMode="ProcessingTime" if ttl_ms else "none",
    )
    return turns.select(F.col("stream").cast("bigint").alias("stream_id"), *NAMES)


def close_open_turns(turns: DataFrame) -> DataFrame:
    """ST3 for a bounded stream: what is still open when the input ends is finished with ``stop``."""
    is_open = F.col("status") == "streaming"
    return turns.withColumns(
        {
            "finish_reason": F.when(is_open, "stop").otherwise(F.col("finish_reason")),
            "status": F.when(is_open, "done").otherwise(F.col("status")),
        }
    )


def latest_turns(updates: DataFrame) -> DataFrame:
    """The last update of every stream (an update sink holds one row per stream and batch)."""
    rest = [c for c in updates.columns if c != "stream_id"]
    best = updates.groupBy("stream_id").agg(
        F.max_by(F.struct(*rest), F.struct("n_events", F.col("status") != "streaming")).alias("t")
    )
    return best.select("stream_id", *[F.col("t")[c].alias(c) for c in rest])
