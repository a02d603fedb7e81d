"""Unigram encoding and decoding: the best-scoring cut of a text into pieces, over a double-array trie.

A space is written as the marker U+2581 and a text begins with one. Characters that no piece covers fall back to one piece per
UTF-8 byte; so does a marker that the text itself holds, which makes decoding exact. The score of a cut is the sum of
its pieces' log scores, a fallen-back character counting ``UNKNOWN`` below the lowest score; of equal scores the cut
whose last piece begins earliest wins, and so on towards the front.

Texts are cut where no piece reaches across (before a marker that follows another character, and around characters that no
piece holds). The parts are encoded once each while a worker remembers them: all new parts of a block walk the trie side by side.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN = 10.0
#: Parts a worker remembers; a full table is started anew. Longer parts than this many bytes are not kept.
CACHE, KEEP = 300_000, 64
#: Text bytes encoded at once, and bytes of parts that walk the trie together (whole texts and parts).
GROUP, WALK = 2 << 20, 4 << 20


@dataclass
class Vocabulary:
    """Pieces by id, with their log scores; ``byte_ids[b]`` is the piece of byte b, other special ids are in ``special``."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    special: set[int]


@lru_cache
def load(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model file that has byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    return Vocabulary(pieces, np.array([model.get_score(i) for i in range(n)]), byte_ids, special)


class Trie:
    """A double array: from state s, byte b leads to base[s] + b if check holds s there. ``value`` is a piece or -1."""

    def __init__(self, pieces: Sequence[tuple[bytes, int]]) -> None:
        ordered = sorted(pieces)
        size = 1 << 12
        self.base, self.check, self.value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.check[0] = 0
        queue, free, dense = [(0, 0, len(ordered), 0)], 1, 1  # ``dense``: before it, gaps seldom have free neighbours
        self.depth = max((len(p) for p, _ in ordered), default=0)
        while queue:
            state, lo, hi, depth = queue.pop()
            while lo < hi and len(ordered[lo][0]) == depth:
                self.value[state] = ordered[lo][1]
                lo += 1
            children: list[list[int]] = []
            for i in range(lo, hi):
                b = ordered[i][0][depth]
                if not children or children[-1][0] != b:
                    children.append([b, i, i])
                children[-1][2] = i + 1
            if not children:
                continue
            labels = np.array([c[0] for c in children])
            while self.check[free] >= 0:
                free += 1
                self._room(free + 8192)
            start, width = (free, 64) if len(labels) == 1 else (max(free, dense), 64)
            while True:  # the first gap whose neighbours are free too
                width = min(2 * width, 4096)
                self._room(start + 8192)
                gaps = start + np.flatnonzero(self.check[start : start + width] < 0)
                fits = gaps if len(labels) == 1 else gaps[(self.check[gaps[:, None] + (labels - labels[0])] < 0).all(axis=1)]
                fits = fits[fits > labels[0]]
                if len(fits):
                    at = int(fits[0]) - int(labels[0])
                    if width > 256:
                        dense = int(fits[0])
                    break
                start += width
            self.base[state] = at
            self.check[at + labels] = state
            queue.extend((at + b, i, j, depth + 1) for b, i, j in children)

    def _room(self, size: int) -> None:
        while size > len(self.check):
            more = len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
            self.value = np.concatenate([self.value, np.full(more, -1, np.int64)])

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and whether there is one."""
        to = self.base[state] + byte
        ok = (self.base[state] > 0) & (to < len(self.check))
        ok[ok] = self.check[to[ok]] == state[ok]
        return to, ok


class Unigram:
    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE) -> None:
        self.v, self.cache = vocabulary, cache
        usable = [(p.encode(), i) for i, p in enumerate(vocabulary.pieces) if i not in vocabulary.special and p]
        self.trie = Trie(usable)
        self.unknown = float(min((vocabulary.scores[i] for _, i in usable), default=0.0)) - UNKNOWN
        held = set("".join(vocabulary.pieces[i] for _, i in usable))
        self.spans = any(MARK in vocabulary.pieces[i].lstrip(MARK) for _, i in usable)
        # runs of characters that some piece holds; any other character is a part of its own
        inside = "".join(re.escape(c) for c in sorted(held | {MARK}))
        self.runs = re.compile(f"[{inside}]+|[^{inside}]", re.S)
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, np.ndarray] = {}
        plain = [(b"" if i in vocabulary.special else p.encode().replace(MARK.encode(), b" ")) for i, p in enumerate(vocabulary.pieces)]
        for b, i in enumerate(vocabulary.byte_ids):
            plain[i] = bytes([b])
        self.plain_at = np.concatenate([[0], np.cumsum([len(p) for p in plain])])
        self.plain = np.frombuffer(b"".join(plain), np.uint8)

    def cut(self, text: str) -> list[str]:
        """Parts of a text whose best cuts make up the best cut of the text; a text's own marker is a part "\\0"."""
        out: list[str] = []
        pieces = text.split(MARK)
        for k, piece in enumerate(pieces):
            if k:
                out.append("\0own mark")
            marked = piece.replace(" ", MARK)
            if not k:
                marked = MARK + marked
            for run in self.runs.findall(marked) if marked else ():
                out.extend([run] if self.spans else self.parts.findall(run))
        return out

    def best(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each part. Parts of like length walk together."""
        raw = [p.encode() for p in parts]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(raw)
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and len(raw[order[j]]) <= 1.3 * len(raw[order[i]]) + 4 and (j - i) * len(raw[order[j]]) < WALK:
                j += 1
            for k, ids in zip(order[i:j], self._walk([raw[k] for k in order[i:j]]), strict=True):
                out[k] = ids
            i = j
        return out

    def _walk(self, raw: list[bytes]) -> list[np.ndarray]:
        size = np.array([len(r) for r in raw])
        n, t = len(raw), int(size.max())
        data = np.zeros((n, t + 1), np.int64)
        data[np.arange(t + 1) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        score = np.full((n, t + 1), -np.inf)
        score[:, 0] = 0
        came, by = np.zeros((n, t + 1), np.int32), np.full((n, t + 1), -1, np.int32)
        lead = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        for i in range(t):
            rows = np.flatnonzero((score[:, i] > -np.inf) & (size > i))
            if not len(rows):
                continue
            stop = np.minimum(i + lead[rows, i], size[rows])  # fallback of the whole character
            self._offer(rows, stop, score[rows, i] + self.unknown, i, -2, score, came, by)
            state = np.zeros(len(rows), np.int64)
            for d in range(i, min(t, i + self.trie.depth)):
                to, ok = self.trie.step(state, data[rows, d])
                ok &= size[rows] > d
                rows, state = rows[ok], to[ok]
                if not len(rows):
                    break
                value = self.trie.value[state]
                end = value >= 0
                r = rows[end]
                self._offer(r, np.full(len(r), d + 1), score[r, i] + self.v.scores[value[end]], i, value[end], score, came, by)
        # back from the ends, all parts at once; a fallen-back character stands for its bytes
        at, steps = size.copy(), []
        live = np.flatnonzero(at > 0)
        while len(live):
            lo = came[live, at[live]]
            steps.append((live, by[live, at[live]], lo, at[live]))
            at[live] = lo
            live = live[lo > 0]
        part, piece, lo, hi = (np.concatenate(x[::-1]) for x in zip(*steps, strict=True))
        order = np.argsort(part, kind="stable")
        part, piece, lo, hi = part[order], piece[order], lo[order], hi[order]
        times = np.where(piece >= 0, 1, hi - lo)
        ids = np.repeat(piece, times).astype(np.int64)
        fallen = np.flatnonzero(ids < 0)
        if len(fallen):
            first = np.repeat(np.cumsum(times) - times, times)
            byte = (np.repeat(lo, times) + np.arange(len(ids)) - first)[fallen]
            ids[fallen] = self.v.byte_ids[data[np.repeat(part, times)[fallen], byte]]
        return np.split(ids, np.cumsum(np.bincount(part, times, minlength=n).astype(np.int64))[:-1])

    @staticmethod
    def _offer(rows, stop, new, start, value, score, came, by) -> None:
        better = new > score[rows, stop]
        r, e = rows[better], stop[better]
        score[r, e], came[r, e] = new[better], start
        by[r, e] = value[better] if isinstance(value, np.ndarray) else value

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        if len(self.known) >= self.cache:
            self.known.clear()
        self.known.setdefault("\0own mark", self.v.byte_ids[list(MARK.encode())])
        cuts = [self.cut(t) for t in texts]
        known = self.known
        new = [p for p in dict.fromkeys(p for c in cuts for p in c) if p not in known]
        if new:
            known.update(zip(new, self.best(new), strict=True))
        out = [np.concatenate([known[p] for p in c]) if c else np.zeros(0, np.int64) for c in cuts]
        for p in new:
            if len(p) > KEEP:
                del known[p]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the text: pieces and bytes joined, markers as spaces, without the leading one."""
        lo, hi = self.plain_at[ids], self.plain_at[ids + 1]
        n = hi - lo
        total = int(n.sum())
        at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return self.plain[at].tobytes()[1:]


@lru_cache
def _ready(path: str) -> Unigram:
    return Unigram(load(path))


def _groups(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    texts, size, first = [], 0, 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= GROUP:
            yield first, i + 1, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, len(column), texts


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ready(path)
        for batch in batches:
            for i, j, texts in _groups(batch.column(1)):
                ids = model.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ready(path)
        for batch in batches:
            texts = [None if x.as_py() is None else model.decode(np.array(x.as_py(), np.int64)).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the ``ids`` of every row's whole text. Null counts as empty, whose ids are those of the lone marker."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_encode(model), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give null."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model), "doc_id long, text string")


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ready(path)
        byte_ids = np.zeros(len(model.v.pieces), bool)
        byte_ids[model.v.byte_ids] = True
        for batch in batches:
            for i, j, texts in _groups(batch.column(1)):
                n, crc, fallen, same = [], [], [], []
                for t, ids in zip(texts, model.encode(texts), strict=True):
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    fallen.append(int(byte_ids[ids].sum()))
                    same.append(model.decode(ids) == t.encode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(fallen, pa.int64()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_ids", "ids_crc32", "n_byte_ids", "round_trip"],
                )

    return run


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row's ids: their number, CRC-32 (as little-endian unsigned 32-bit), the number of byte pieces, and
    whether decoding them gives back the text."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_digest(model), "doc_id long, n_ids long, ids_crc32 long, n_byte_ids long, round_trip boolean")
