"""What the operators share: Arrow text blocks, word hashes, size-checked broadcasts, components.

Text kernels work on the UTF-8 bytes of a run of whole rows (`blocks`). Such a run has about ``BLOCK`` bytes, or is a
single longer row, so memory in a task depends on the longest text and not on the rows of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import discard, staged

BLOCK = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows (or list elements), of a few numbers each, up to which a staged table is sent to every executor.
BROADCAST_ROWS = 1_000_000

U64 = np.uint64
_rng = np.random.default_rng(20240229)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD_BYTE = np.where(IS_SPACE, U64(0), BYTE)
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """Broadcast a staged table of narrow rows if it holds at most BROADCAST_ROWS of them; else leave the join to a shuffle.

    ``size`` counts the elements of a row that holds a list. ``df`` must read files (see ``staged``).
    """
    n = df.select(F.sum(size) if size is not None else F.count(F.lit(1))).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        n = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INV)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets in them) of runs of whole rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string() if pa.types.is_large_string(column.type) else pa.string())
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offs = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        yield first, last, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run of bytes other than space and 0x09-0x0D inside a row), and its row."""
    solid = ~IS_SPACE[buf]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = offs[1:] > offs[:-1]
    firsts, lasts = offs[:-1][full], offs[1:][full] - 1
    start[firsts] = solid[firsts]
    end[lasts] = solid[lasts]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word. Sums run over slices of about BLOCK bytes, so long rows need no long tables."""
    out = np.zeros(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + BLOCK, "right")))
        span = int(e[j - 1] - s[i])
        if span > 2 * BLOCK:  # one very long word
            total, shift = U64(0), U64(1)
            up, _ = powers(2 * BLOCK)
            for k in range(int(s[i]), int(e[i]), BLOCK):
                piece = WORD_BYTE[buf[k : min(k + BLOCK, int(e[i]))]]
                total += (piece * up[: len(piece)]).sum(dtype=np.uint64) * shift
                shift *= up[BLOCK]
            out[i] = total
        else:
            up, down = powers(span)
            rel = s[i:j] - s[i]
            out[i:j] = np.add.reduceat(WORD_BYTE[buf[s[i] : e[j - 1]]] * up[:span], rel) * down[rel]
        i = j
    return mix(out)


_FRONT = np.array([0] + [((1 << (8 * n)) - 1) << (64 - 8 * n) for n in range(1, 9)], np.uint64)
#: Bytes of a word that are mixed eight at a time; what follows in a longer word is digested as a whole.
PRINTED = 256


def word_prints(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, where no sum of byte values can cancel out: eight bytes at a time are mixed in turn."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(8, np.uint8)]), 8)
    out = mix((e - s).astype(np.uint64) + BASE)
    active = np.arange(len(s))
    for done in range(0, PRINTED, 8):
        active = active[e[active] - s[active] > done]
        if not len(active):
            return out
        at = s[active] + done
        chunk = view[at].view(">u8").ravel().astype(np.uint64) & _FRONT[np.minimum(e[active] - at, 8)]
        out[active] = mix(out[active] * U64(3) + chunk)
    for i in active[e[active] - s[active] > PRINTED]:
        rest = hashlib.blake2b(buf[s[i] + PRINTED : e[i]].tobytes(), digest_size=8).digest()
        out[i] = mix(out[i : i + 1] * U64(3) + np.frombuffer(rest, np.uint64))[0]
    return out


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingle hashes of each row, in row order, and the row limits in them.

    A row with fewer words has its whole sequence as the one shingle; a row without words has none.
    """
    n_words = np.bincount(row, minlength=n_rows)
    g = np.zeros(len(h), np.uint64)
    acc = np.full(len(h), U64(width))
    same = np.ones(len(h), bool)
    for k in range(width):
        m = len(h) - k
        if m <= 0:
            same[:] = False
            break
        acc[:m] = mix(acc[:m] * U64(3) + h[k:])
        same[m:] = False
        same[:m] &= row[k:] == row[:m]
    g[same] = acc[same]
    keep = same
    ends = np.cumsum(n_words)
    starts = ends - n_words
    for r in np.flatnonzero((n_words > 0) & (n_words < width)):
        v = U64(1000 + int(n_words[r]))
        for k in range(starts[r], ends[r]):
            v = mix(np.array([v * U64(3) + h[k]], np.uint64))[0]
        g[starts[r]] = v
        keep[starts[r]] = True
    parts, limits = [], np.zeros(n_rows + 1, np.int64)
    for r in range(n_rows):
        u = np.unique(g[starts[r] : ends[r]][keep[starts[r] : ends[r]]])
        parts.append(u)
        limits[r + 1] = limits[r] + len(u)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), limits


def ragged(values: np.ndarray, limits: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(values, kind))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a two-dimensional uint8 array."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node that links reach.

    Labels fall along links and then jump to the label of their label, so rounds grow with the logarithm of a
    chain's length. Each round is written to the shared folder; links and labels stay distributed.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = staged(both, "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        hooked = staged(labels.join(near, labels.node == near.a).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was")), "hooked")
        target = hooked.select(F.col("node").alias("t"), F.col("comp").alias("up"))
        jumped = staged(hooked.join(target, hooked.comp == target.t).select("node", F.least("comp", "up").alias("comp"), "was"), "jumped")
        moved = jumped.where("comp <> was").limit(1).count()
        discard(labels, hooked)
        labels = jumped.select("node", "comp")
        if not moved:
            discard(both)
            return labels


def class_bounds(buf: np.ndarray, offs: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes of one kind (``kinds[byte]``, 0: none) inside a row, and its row."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    kind = kinds[buf]
    new = np.ones(len(buf), bool)
    new[1:] = kind[1:] != kind[:-1]
    firsts = offs[:-1][offs[1:] > offs[:-1]]
    new[firsts] = True
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(buf))
    real = kind[at] != 0
    s, e = at[real], ends[real]
    return s, e, np.searchsorted(offs, s, "right") - 1


#: White space, letters and digits (bytes of other alphabets count as letters), and signs.
KINDS = np.full(256, 2, np.uint8)
KINDS[IS_SPACE] = 0
KINDS[48:58] = KINDS[65:91] = KINDS[97:123] = KINDS[128:] = 1
