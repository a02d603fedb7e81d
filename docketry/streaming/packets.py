"""ST1: server-sent event packets to typed events; bodies that arrive in pieces, cut at any byte, to packets."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docketry.functions.jsontext import strict_json
from docketry.functions.text import BLANKS, let, strip
from docketry.streaming.waiting import DIRECTORY, OfStream, Waiting, by_stream, group_of, stored

DEFAULT_EVENT = "message"


def _lines_with(lines: Column, prefix: str) -> Column:
    hits = F.filter(lines, lambda x: F.startswith(x, F.lit(prefix)))
    return F.transform(hits, lambda x: strip(F.substr(x, F.lit(len(prefix) + 1))))


def parse_packets(packets: DataFrame, keep_numbers: bool = False) -> DataFrame:
    """(stream_id, seq, packet) to (stream_id, seq, event, payload).

    The last ``event:`` line names the event; the ``data:`` lines together are its JSON. Packets
    without data or with bad JSON are dropped, or with ``keep_numbers`` stay as rows without event and
    payload: the fold then sees no gap in the numbers.
    """
    lines = F.split(strip(F.replace("packet", F.lit("\r"), F.lit(""))), "\n")
    cut = packets.withColumn("_lines", lines)
    event = F.coalesce(F.get(F.reverse(_lines_with(F.col("_lines"), "event:")), F.lit(0)), F.lit(DEFAULT_EVENT))
    data = F.array_join(_lines_with(F.col("_lines"), "data:"), "\n")
    has_data = F.exists("_lines", lambda x: F.startswith(x, F.lit("data:")))
    payload = let(data, lambda d: strict_json(d))
    if keep_numbers:
        read = cut.withColumn("payload", F.when(has_data, payload))
        return read.withColumn("event", F.when(F.col("payload").isNotNull(), event)).drop("_lines", "packet")
    return (
        cut.where(has_data)
        .withColumns({"event": event, "payload": payload})
        .where(F.col("payload").isNotNull())
        .drop("_lines", "packet")
    )


class PacketCutter(StatefulProcessor):
    """State of one body: the bytes behind its last blank line, and the pieces that came ahead of their turn. Bodies come in groups.

    Pieces are numbered from ``first_piece`` on. Carriage returns are dropped, a blank line ends a packet, blank packets
    count as none; packets are numbered from 1. Replayed pieces are ignored. Bytes are decoded packet by packet, so a
    character that two pieces share is whole; bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, first_piece: int):
        self._first = first_piece

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._at = handle.getMapState("at", "stream string", f"piece bigint, packets bigint, tail binary, {DIRECTORY}")
        self._later = handle.getMapState("later", "stream string, chunk bigint", "pieces array<bigint>, bodies array<binary>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = by_stream(rows, ["piece", "body"])
        out: tuple[list, list, list] = ([], [], [])
        for stream, at in stored(self._at, new):
            found, packets = self._one(stream, at, sorted(new[stream], key=itemgetter(0)))
            out[0].extend([stream] * len(found))
            out[1].extend(range(packets + 1, packets + 1 + len(found)))
            out[2].extend(found)
        if out[0]:
            yield pd.DataFrame(dict(zip(("stream", "seq", "packet"), out, strict=True)))

    def _one(self, stream: str | None, at: tuple | None, rows: list) -> tuple[list[str], int]:
        """The packets that the new pieces of a body finish, and how many there were before."""
        piece, packets, tail, ids, starts = at or (self._first, 0, b"", (), ())
        tail, waiting = bytearray(tail), Waiting(OfStream(self._later, stream), ids, starts)
        found: list[str] = []
        ahead: dict[int, bytes] = {}
        for number, body in rows:
            if number == piece:
                piece += 1
                _cut(tail, bytes(body), found)
            elif number > piece:
                ahead[int(number)] = bytes(body)
        while True:
            ahead = waiting.open(piece) | ahead
            if piece not in ahead:
                break
            while piece in ahead:
                _cut(tail, bytes(ahead.pop(piece)), found)
                piece += 1
        waiting.close({n: body for n, body in ahead.items() if n > piece})
        self._at.updateValue((stream,), (int(piece), packets + len(found), bytes(tail), *waiting.directory()))
        return found, packets

    def close(self) -> None:
        pass


def _cut(tail: bytearray, body: bytes, found: list[str]) -> None:
    """Add a piece to ``tail`` and take the finished packets out of it."""
    look = max(0, len(tail) - 1)
    tail += body.replace(b"\r", b"")
    start = 0
    while (end := tail.find(b"\n\n", look)) >= 0:
        packet = tail[start:end].decode(errors="replace").strip(BLANKS)
        if packet:
            found.append(packet)
        start = look = end + 2
    del tail[:start]


def cut_pieces(pieces: DataFrame, first_piece: int = 0) -> DataFrame:
    """A stream of body pieces (stream_id, piece, body: bytes) to packets (stream_id, seq, packet).

    Append mode, RocksDB. A body's state is its unfinished packet, and the pieces ahead of a missing one.
    """
    kind = pieces.schema["stream_id"].dataType
    # the name of a body travels as text: pandas has no whole numbers with NULLs among them
    body = F.coalesce(F.col("body").cast("binary"), F.lit(b"")).alias("body")
    rows = pieces.select(group_of("stream_id"), F.col("stream_id").cast("string").alias("stream"), F.col("piece").cast("bigint").alias("piece"), body)
    found = rows.groupBy("group").transformWithStateInPandas(
        statefulProcessor=PacketCutter(first_piece), outputStructType="stream string, seq bigint, packet string", outputMode="append", timeMode="none"
    )
    return found.select(F.col("stream").cast(kind).alias("stream_id"), "seq", "packet")


def split_bodies(bodies: DataFrame) -> DataFrame:
    """Complete stream bodies (stream_id, body) to packets; an unterminated tail is dropped.

    For stored bodies, one row each.
    """
    pieces = F.split(F.replace("body", F.lit("\r"), F.lit("")), "\n\n")
    return (
        bodies.select("stream_id", F.posexplode(F.slice(pieces, F.lit(1), F.size(pieces) - 1)).alias("seq", "packet"))
        .where(strip("packet") != "")
        .withColumn("seq", F.col("seq").cast("bigint"))
    )


def typed_events(events: DataFrame) -> DataFrame:
    """Events with the members the fold needs; wrong-typed members become NULL."""
    from docketry.functions.jsontext import kind, member

    def string(name):
        m = member(F.col("payload"), f"$.{name}")
        return F.when(kind(m) == "string", F.try_variant_get("payload", f"$.{name}", "string"))

    sources = member(F.col("payload"), "$.rag_sources")
    return events.select(
        *[c for c in events.columns if c not in ("payload", "event")],
        "event",
        F.when(F.col("event") == "error", string("detail")).otherwise(string("text")).alias("text"),
        string("rag_note").alias("note"),
        string("finish_reason").alias("reason"),
        F.when(kind(sources) == "array", F.to_json(sources)).alias("sources"),
    )
