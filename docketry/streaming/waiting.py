"""Rows of one key that wait for their turn, kept in the state in chunks.

A call to the state store costs far more than a row does. So all rows that a batch leaves waiting are written by one call for
each ``CHUNK`` of them, and read back the same way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 4096
DIRECTORY = "ids array<bigint>, starts array<bigint>"
#: Groups that streams are dealt to. A call for a group serves all of its streams, since a call costs as much as thousands of rows;
#: a task holds the new rows of one group.
GROUPS = 2048


def group_of(stream: str) -> Column:
    return F.pmod(F.xxhash64(stream), F.lit(GROUPS)).cast("int").alias("group")


def by_stream(frames: Iterable[pd.DataFrame], columns: list[str]) -> dict:
    """The rows (as tuples of ``columns``) of each ``stream`` of a group's new rows."""
    found: dict = {}
    for frame in frames:
        for stream, *row in zip(frame["stream"].tolist(), *(frame[c].tolist() for c in columns), strict=True):
            found.setdefault(stream if isinstance(stream, str) else None, []).append(row)
    return found


def stored(state, streams: Iterable[str | None]) -> Iterator[tuple[str | None, tuple | None]]:
    """Every stream with its value in the map state ``state``; a group without any is asked once."""
    some = state.exists()
    for stream in list(streams):
        yield stream, state.getValue((stream,)) if some and state.containsKey((stream,)) else None


class OfStream:
    """The part of a map state, keyed by stream and chunk, that belongs to one stream."""

    def __init__(self, state, stream: str | None):
        self._state, self._stream = state, stream

    def getValue(self, key: tuple) -> tuple:
        return self._state.getValue((self._stream, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self._state.updateValue((self._stream, *key), value)

    def removeKey(self, key: tuple) -> None:
        self._state.removeKey((self._stream, *key))


class Waiting:
    """Waiting items by number. ``chunks``: a map state from a chunk's id to (numbers, items); ``ids`` and ``starts`` (the smallest
    number of each) are its directory, which the caller stores with the state of the key."""

    def __init__(self, chunks, ids=(), starts=()):
        self._chunks, self._starts, self._opened = chunks, dict(zip(ids, starts, strict=True)), {}

    def __len__(self) -> int:
        return len(self._starts)

    def open(self, upto: int | None = None) -> dict:
        """The items of all chunks not opened yet, or of those that start at ``upto`` or before."""
        found: dict = {}
        for k, start in self._starts.items():
            if k not in self._opened and (upto is None or start <= upto):
                self._opened[k], items = self._chunks.getValue((k,))
                # structs come back as rows, which cannot be written again
                found.update((n, tuple(x) if isinstance(x, tuple) else x) for n, x in zip(self._opened[k], items, strict=True))
        return found

    def close(self, items: dict) -> None:
        """Store ``items``: what still waits of the chunks opened before, and new ones. Whole chunks are left as they are."""
        fresh = set(items)
        for k, numbers in self._opened.items():
            if items.keys() >= set(numbers):
                fresh.difference_update(numbers)
        for k, numbers in self._opened.items():
            if not items.keys() >= set(numbers):
                self._chunks.removeKey((k,))
                del self._starts[k]
        ordered = sorted(fresh)
        for i in range(0, len(ordered), CHUNK):
            part = ordered[i : i + CHUNK]
            k = max(self._starts, default=-1) + 1
            self._chunks.updateValue((k,), (part, [items[n] for n in part]))
            self._starts[k] = part[0]
        self._opened = {}

    def clear(self) -> None:
        for k in self._starts:
            self._chunks.removeKey((k,))
        self._starts, self._opened = {}, {}

    def directory(self) -> tuple[list[int], list[int]]:
        return list(self._starts), list(self._starts.values())
