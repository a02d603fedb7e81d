"""Packing along a space-filling curve.

1. A document's vector is the mean of hashed random projections of its words, in ``DIMS`` dimensions.
2. Its place on a Hilbert curve through the quantised vectors is a 64-bit key; the rows are range-sorted by it. The
   borders of the ranges come from a sample that draws texts by their bytes, so ranges hold equal bytes, not equal rows.
3. Every range is tokenised and cut into sequences of ``length`` tokens as it streams by, so neighbours on the curve
   share sequences and the only padding is in the last sequence of a range.

Texts cross the network once, before they are tokenised; nothing but the open sequence is held in a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import bpe
from docketry.llm.common import TO_LOWER, U64, blocks, mix, signed, word_bounds, word_hashes

DIMS, BITS = 4, 10
#: Text bytes of a range, about; a range leaves at most one sequence unfilled. Beyond MAX_RANGES ranges they grow.
RANGE_BYTES, MAX_RANGES = 32 << 20, 1 << 16
#: Rows drawn for the borders: about SAMPLES for each range, MAX_SAMPLES in all (24 bytes each, on the driver).
SAMPLES, MAX_SAMPLES = 64, 1 << 22


def vectors(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One vector of DIMS numbers for each row: the scaled sum of its words' projections; zero without words."""
    s, e, row = word_bounds(buf, offs)
    out = np.zeros((len(offs) - 1, DIMS))
    if len(s):
        h = word_hashes(buf, s, e)
        n = np.bincount(row, minlength=len(out))
        full = n > 0
        starts = (np.cumsum(n) - n)[full]
        for d in range(DIMS):
            part = ((mix(h + U64(d + 1)) >> U64(40)).astype(np.float64) / (1 << 23)) - 1.0
            out[full, d] = np.add.reduceat(part, starts) / np.sqrt(n[full])
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cell coordinates (uint64, below 2**bits) on the Hilbert curve."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    q = U64(1 << (bits - 1))
    while q > 1:  # undo the rotations and reflections of every level
        low = q - U64(1)
        for d in range(dims):
            high = (x[d] & q) != 0
            swap = np.where(high, U64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, swap)
            if d:
                x[d] ^= swap
        q >>= U64(1)
    for d in range(1, dims):  # Gray code
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    q = U64(1 << (bits - 1))
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - U64(1), U64(0))
        q >>= U64(1)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << U64(1)) | ((x[d] >> U64(b)) & U64(1))
    return key


def places(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Place of each row on the curve."""
    side = 1 << BITS
    cells = np.clip((np.tanh(vectors(TO_LOWER[buf], offs) / 4) + 1) / 2 * side, 0, side - 1).astype(np.uint64)
    return signed(hilbert(cells, BITS))


def _weigh(share: float):
    """A sample of the places: a row is taken with a probability of ``share`` for each byte, and stands for its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tie = batch.column("tie").to_numpy()
            for i, j, buf, offs in blocks(batch.column("text")):
                size = np.diff(offs) + 1
                chance = np.minimum(1.0, size * share)
                drawn = np.flatnonzero((mix(tie[i:j].view(U64)) >> U64(11)) * 2.0**-53 < chance)
                if len(drawn):
                    ends = np.concatenate([[0], np.cumsum(size[drawn] - 1)])
                    some = np.concatenate([buf[offs[k] : offs[k + 1]] for k in drawn])
                    yield pa.RecordBatch.from_arrays([pa.array(places(some, ends)), pa.array(tie[i:j][drawn]), pa.array(size[drawn] / chance[drawn])], ["curve", "tie", "bytes"])

    return run


def borders(sample: pa.Table, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Curve place and tie of the first row of every range but the first, where the sampled bytes reach equal parts."""
    curve, tie, size = (sample.column(c).to_numpy() for c in ("curve", "tie", "bytes"))
    order = np.lexsort((tie, curve))
    curve, tie, total = curve[order], tie[order], np.cumsum(size[order])
    if not len(total):
        return curve, tie
    at = np.unique(np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges))
    at = at[(at > 0) & (at < len(total))]
    return curve[at], tie[at]


def _place(curves: np.ndarray, ties: np.ndarray):
    """Every row with its place and its range: the number of borders at or before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tie = batch.column("tie").to_numpy()
            for i, j, buf, offs in blocks(batch.column("text")):
                curve = places(buf, offs)
                span = np.searchsorted(curves, curve, "left")
                level = np.searchsorted(curves, curve, "right")
                for value in np.unique(curve[level > span]):  # borders inside one place: the tie decides
                    mine = curve == value
                    lo, hi = np.searchsorted(curves, [value, value + 1], "left")
                    span[mine] = lo + np.searchsorted(ties[lo:hi], tie[i:j][mine], "right")
                cut = [batch.column(c).slice(i, j - i) for c in ("doc_id", "text")]
                yield pa.RecordBatch.from_arrays([*cut, pa.array(curve), pa.array(tie[i:j]), pa.array(span.astype(np.int32))], ["doc_id", "text", "curve", "tie", "span"])

    return run


def _pack(path: str, end_id: int, length: int):
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = bpe.load(path), np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        at = 0
        last_text, last_ids = None, None
        for batch in batches:
            out: list[list] = [[] for _ in columns]
            for doc, text, curve in zip(*(batch.column(k) for k in ("doc_id", "text", "curve")), strict=True):
                text = text.as_py() or ""
                if last_ids is None or text != last_text:  # copies follow each other on the curve
                    last_ids = tokens.encode(text).astype("<u4").tobytes() + end
                    last_text = text
                n, start, doc, curve = len(last_ids) // 4, 0, doc.as_py(), curve.as_py()
                while start < n:
                    take = min(n - start, length - at)
                    crc = zlib.crc32(last_ids[4 * start : 4 * (start + take)])
                    for column, v in zip(out, (doc, start, take, crc, n, sequence, at, curve), strict=True):
                        column.append(v)
                    start, at = start + take, at + take
                    if at == length:
                        sequence, at = sequence + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], list(columns))

    return run


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the place on the ``curve``.

    A document's ids are those of its text and then ``end_id``; null counts as empty, so every row has one piece at
    least. Documents are cut freely. Rows of one place are ordered, and spread over ranges, by a hash of id and text,
    so a place that a third of the rows share is no bound. Equal rows give equal pieces. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    ranges = max(1, min(MAX_RANGES, -(-size // range_bytes)))
    keyed = rows.withColumn("tie", F.xxhash64("text", "doc_id"))
    curves, ties = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if ranges > 1:
        share = min(SAMPLES, MAX_SAMPLES // ranges) * ranges / size
        curves, ties = borders(keyed.mapInArrow(_weigh(share), "curve long, tie long, bytes double").toArrow(), ranges)
    placed = keyed.mapInArrow(_place(curves, ties), "doc_id long, text string, curve long, tie long, span int")
    ordered = placed.repartitionById(len(curves) + 1, "span").sortWithinPartitions("curve", "tie", "doc_id")
    return ordered.select("doc_id", "text", "curve").mapInArrow(
        _pack(tokenizer, end_id, length),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long",
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, its tokens and the documents in it, in order."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), inside.alias("pieces"))
