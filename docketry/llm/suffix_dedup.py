"""Repeated byte strings by longest-previous-factor arrays.

A suffix array over all bytes would be many times the input. Two copies of a ``min_bytes`` string also agree on the
position of their smallest ``GRAM``-byte hash (the string's anchor), so suffixes can be sorted in separate bins:

1. Consecutive strings of a text that have one anchor form a run. Runs whose anchor occurs nowhere else are done.
2. Equal runs count as one, with their number and first place; where a run occurs twice, all its strings do.
3. The distinct runs of an anchor go to one bin. There suffixes are sorted by induction: from the order of the
   suffixes at the anchor follows, one byte at a time to the left, the order of the suffixes that begin before it, with
   their longest common prefixes. In suffix order, strings of one value form an interval of prefixes >= min_bytes; the previous
   and next smaller text positions of a suffix inside its interval are its earlier matches (previous factor), the
   larger ones its later matches (next factor).
4. An anchor with very many distinct runs (the edge of a passage that a third of all texts share) is first split by
   the bytes that ``SPLIT`` neighbouring strings have in common, and, where that leaves too many, by whole strings.

Positions order texts by (doc_id, fingerprint of the text, offset).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StructType

from docketry.llm.common import BYTE, U64, blocks, mix, powers, signed
from docketry.session import discard, staged

GRAM = 32
#: Bytes that are hashed at once, some 130 bytes of tables for each; longer texts are read in overlapping pieces.
PIECE = 1 << 18
#: Distinct runs of one anchor that one bin sorts at most, and runs of a bin on average.
HOT_RUNS, BIN_RUNS = 32768, 2048
SPLIT = 32


def _prefix(buf: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers; differences give the hash of any substring."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[buf] * up[: len(buf)], out=out[1:])
    return out


def _hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[hi] - prefix[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def runs(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor, anchor's hash, run's hash) of the runs of ``length``-byte strings of each row.

    The bytes may be at most 2**24; starts and anchors count from the beginning of ``buf``.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = _prefix(buf)
    at = np.arange(len(buf) - GRAM + 1)
    gram = _hash(prefix, at, at + GRAM)
    # smallest hash of a window, the leftmost on a tie: order by hash, then position
    key = (gram & ~U64((1 << 24) - 1)) | at.astype(np.uint64)
    w = length - GRAM + 1
    n = len(key) - w + 1
    pad = -len(key) % w
    table = np.concatenate([key, np.full(pad, ~U64(0), np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    anchor = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & U64((1 << 24) - 1)).astype(np.int64)
    row = np.searchsorted(offs, np.arange(n), "right") - 1
    valid = np.arange(n) + length <= offs[row + 1]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.ones(n, bool)
    stop[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    m = anchor[first]
    data = buf.tobytes()
    # sums modulo 2**64 may cancel out; what is removed without another look needs a real digest
    whole = b"".join([hashlib.blake2b(data[a : b + length], digest_size=8).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)])
    return row[first], first, last, m, gram[m], np.frombuffer(whole, np.uint64)


def _find(length: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, buf, offs in blocks(batch.column(2), piece):
                for base in range(0, max(1, len(buf)), piece):
                    # strings that begin in [base, base + piece) of a text; only a single long row has several pieces
                    part = buf[base : base + piece + length - 1]
                    limits = offs if len(buf) <= piece else np.array([0, len(part)])
                    row, first, last, m, gram, whole = runs(part, limits, length)
                    start = limits[row] - base
                    take = pa.array(i + row)
                    ints = [pa.array(x - start, pa.int64()) for x in (first, last, m)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), *ints, pa.array(signed(gram), pa.int64()), pa.array(signed(whole), pa.int64())],
                        ["doc_id", "print", "first", "last", "anchor", "gram", "run"],
                    )

    return run


def _cut(length: int):
    """Bytes of the wanted runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, texts, wanted = (batch.column(k) for k in range(4))
            out: dict[str, list] = {k: [] for k in ("doc_id", "print", "first", "last", "anchor", "gram", "run", "body")}
            size = 0
            for i, (text, rows) in enumerate(zip(texts, wanted, strict=True)):
                data = (text.as_py() or "").encode()
                for r in rows.as_py():
                    body = data[r["first"] : r["last"] + length]
                    for k, v in (("doc_id", ids[i].as_py()), ("print", prints[i].as_py()), ("body", body), *r.items()):
                        out[k].append(v)
                    size += len(body)
                    if size > 4 << 20:
                        yield _batch(out)
                        out, size = {k: [] for k in out}, 0
            yield _batch(out)

    return run


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "body" else pa.int64()) for k, v in out.items()], list(out))


def _range_min(lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest lcp[lo..hi] (both included) of each pair."""
    levels = [lcp]
    while 2 << (len(levels) - 1) <= len(lcp):
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    out = np.empty(len(lo), lcp.dtype)
    size = np.int64(np.log2(hi - lo + 1)) if len(lo) else np.zeros(0, np.int64)
    for k in np.unique(size):
        at = size == k
        out[at] = np.minimum(levels[k][lo[at]], levels[k][hi[at] - (1 << int(k)) + 1])
    return out


def matched(group: np.ndarray, bodies: list[bytes], left: np.ndarray, low: np.ndarray, order: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Strings of distinct runs that occur again, by one offset before the anchor at a time.

    Run i has ``left[i]`` bytes before its anchor and owns the strings that begin low[i]..left[i] bytes before it; runs of
    one ``group`` share the anchor. ``order`` ranks text positions. Yields (offset, runs, whether an earlier match exists,
    run with the earliest match).
    """
    n = len(bodies)
    sizes = np.array([len(b) for b in bodies])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    anchor = starts + left
    right = sizes - left
    # order of the suffixes at the anchor and their common prefixes
    tails = [bodies[i][left[i] :] for i in range(n)]
    rank = np.array(sorted(range(n), key=lambda i: (group[i], tails[i])), np.int64)
    lcp = np.full(n, -(1 << 30), np.int64)
    for lo in range(1, n, 4096):
        a, b = rank[lo - 1 : min(lo + 4096, n) - 1], rank[lo : min(lo + 4096, n)]
        room = np.minimum(right[a], right[b])
        cols = np.arange(int(room.max()))
        inside = cols[None, :] < room[:, None]
        x = data[np.minimum(anchor[a][:, None] + cols, len(data) - 1)]
        y = data[np.minimum(anchor[b][:, None] + cols, len(data) - 1)]
        same = np.logical_and.accumulate((x == y) & inside, axis=1).sum(axis=1)
        lcp[lo : lo + len(a)] = np.where(group[a] == group[b], same, -(1 << 30))
    for off in range(int(left.max()) + 1):
        if off:
            alive = np.flatnonzero(left[rank] >= off)
            # what lies apart can only grow by one byte a step
            near = np.maximum(lcp, np.append(lcp[1:], -(1 << 30)))
            alive = alive[near[alive] + left[rank[alive]] - off + 1 >= length]
            if not len(alive):
                return
            byte = data[anchor[rank[alive]] - off].astype(np.int64)
            key = group[rank[alive]] * 256 + byte
            move = np.argsort(key, kind="stable")
            at, key = alive[move], key[move]
            fresh = np.full(len(at), -(1 << 30), np.int64)
            pair = np.flatnonzero(key[1:] == key[:-1]) + 1
            fresh[pair] = 1 + _range_min(lcp, at[pair - 1] + 1, at[pair])
            rank, lcp = rank[at], fresh
        head = lcp < length
        if head.all():
            continue
        first = np.flatnonzero(head)
        least = np.minimum.reduceat(order[rank], first)
        which = np.cumsum(head) - 1
        count = np.diff(np.append(first, len(rank)))
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        hit = count[which] > 1
        yield off, rank[hit], least[which[hit]] < order[rank[hit]], back[least[which[hit]]]


def _bin(length: int):
    """Intervals of string starts, in the text, with a match: any (earlier = false) or an earlier one (true)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["key", "run", "first"], ignore_index=True)  # rows equal in id and text bring a run twice
        n = len(pdf)
        order = np.empty(n, np.int64)
        order[np.lexsort((pdf.anchor, pdf["print"], pdf.doc_id))] = np.arange(n)
        _, group = np.unique(pdf.key.to_numpy(np.int64), return_inverse=True)
        anchor = pdf.anchor.to_numpy(np.int64)
        left, low = anchor - pdf["first"].to_numpy(np.int64), anchor - pdf["last"].to_numpy(np.int64)
        hits: tuple[list, list] = ([], [])
        for off, who, later, _ in matched(group, list(pdf.body), left, low, order, length):
            hits[0].append((who, np.full(len(who), off)))
            hits[1].append((who[later], np.full(int(later.sum()), off)))
        parts = []
        for earlier, found in zip((False, True), hits, strict=True):
            if not found:
                continue
            who, off = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(who):
                continue
            start = anchor[who] - off
            by = np.lexsort((start, who))
            who, start = who[by], start[by]
            new = np.ones(len(who), bool)
            new[1:] = (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)
            lo, hi = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(who)) - 1
            src = pdf.iloc[who[lo]]
            parts.append(pd.DataFrame({"doc_id": src.doc_id.to_numpy(), "print": src["print"].to_numpy(), "lo": start[lo], "hi": start[hi], "earlier": earlier}))
        if not parts:
            return pdf.assign(lo=pdf["first"], hi=pdf["first"], earlier=False)[["doc_id", "print", "lo", "hi", "earlier"]].iloc[:0]
        return pd.concat(parts)

    return run


def _refine(length: int, step: int):
    """A row for every ``step`` neighbouring strings of a run, keyed by the bytes that these have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            out: dict[str, list] = {k: [] for k in names}
            for r in batch.to_pylist():
                body, left, low = r["body"], r["anchor"] - r["first"], r["anchor"] - r["last"]
                for b in range(low // step, left // step + 1):
                    far, near = min(left, b * step + step - 1), max(low, b * step)
                    # common to all strings that begin b*step .. b*step+step-1 bytes before the anchor
                    lo, hi = left - b * step, left - (b * step + step - 1) + length
                    core = int.from_bytes(hashlib.blake2b(body[lo:hi], digest_size=8).digest(), "little")
                    key = mix(np.array([(core * 31 + b + r["key"]) & ((1 << 64) - 1)], np.uint64))
                    for k in names:
                        out[k].append(r[k])
                    out["key"][-1] = int(signed(key)[0])
                    out["first"][-1], out["last"][-1] = r["anchor"] - far, r["anchor"] - near
                    out["body"][-1] = body[left - far : left - near + length]
            yield _batch(out)

    return run


def intervals(docs: DataFrame, length: int, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, print, lo, hi, earlier) over ``docs`` (doc_id, print, text; no nulls): starts lo..hi begin repeated strings.

    Rows with ``earlier`` = false are those with any other occurrence, rows with true those with an earlier one.
    """
    if length <= GRAM:
        raise ValueError(f"strings must have more than {GRAM} bytes")
    found = docs.select("doc_id", "print", "text").mapInArrow(
        _find(length, PIECE), "doc_id long, print long, first long, last long, anchor long, gram long, run long"
    )
    every = staged(found, "runs")
    shared = staged(every.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("gram"), "anchors")
    found, every = every, staged(every.join(shared.hint("merge"), "gram", "left_semi"), "shared_runs")
    discard(found, shared)
    place = F.struct("doc_id", "print", "first", "last", "anchor")
    distinct = staged(every.groupBy("run", "gram").agg(F.count(F.lit(1)).alias("m"), F.min(place).alias("at")).select("run", "gram", "m", "at.*"), "distinct_runs")

    # whole runs that occur twice
    twice = staged(distinct.where("m > 1").select("run", "gram", F.col("doc_id").alias("d0"), F.col("print").alias("p0"), F.col("first").alias("f0")), "twice")
    again = every.join(twice.hint("merge"), ["run", "gram"]).select(
        "doc_id", "print", F.col("first").alias("lo"), F.col("last").alias("hi"),
        (~((F.col("doc_id") == F.col("d0")) & (F.col("print") == F.col("p0")) & (F.col("first") == F.col("f0")))).alias("later"),
    )
    whole = again.select("doc_id", "print", "lo", "hi", F.explode(F.when(F.col("later"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("earlier"))

    # runs that differ but share an anchor
    several = distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1")
    several = staged(several, "several")
    wanted = distinct.join(several, "gram").select("doc_id", "print", "first", "last", "anchor", "gram", "run")
    wanted = staged(wanted.groupBy("doc_id", "print").agg(F.collect_list(F.struct("first", "last", "anchor", "gram", "run")).alias("wanted")), "wanted_runs")
    wanted = wanted.select(F.col("doc_id").alias("wid"), F.col("print").alias("wprint"), "wanted")
    texts = docs.join(wanted.hint("merge"), (docs["doc_id"] == F.col("wid")) & (docs["print"] == F.col("wprint"))).select("doc_id", "print", "text", "wanted")
    bodies = texts.mapInArrow(_cut(length), "doc_id long, print long, first long, last long, anchor long, gram long, run long, body binary")
    bodies = staged(bodies, "bodies").withColumn("key", F.col("gram")).drop("gram")
    shape = bodies.schema
    parts = []
    for step in (SPLIT, 1):
        counts = staged(bodies.groupBy("key").agg(F.count(F.lit(1)).alias("runs")), "counts")
        hot = staged(counts.where(F.col("runs") > hot_runs).select("key"), "hot")
        if not hot.limit(1).count():
            break
        parts.append(bodies.join(hot, "key", "left_anti"))
        split = staged(bodies.join(hot, "key", "left_semi").select(*shape.names).mapInArrow(_refine(length, step), shape), "split")
        alive = staged(split.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "alive")
        bodies = split.join(alive, "key", "left_semi").select(*shape.names)
    else:
        # single strings: equal keys are equal strings, nothing is left to sort
        heads = bodies.groupBy("key").agg(F.min(F.struct("doc_id", "print", "first")).alias("head"))
        heads = staged(heads, "heads")
        single = bodies.join(heads, "key").select(
            "doc_id", "print", F.col("first").alias("lo"), F.col("last").alias("hi"), (F.struct("doc_id", "print", "first") != F.col("head")).alias("later")
        )
        whole = whole.union(single.select("doc_id", "print", "lo", "hi", F.lit(False))).union(single.where("later").select("doc_id", "print", "lo", "hi", F.lit(True)))
        bodies = None
    if bodies is not None:
        parts.append(bodies)
    cold = parts[0].select(*shape.names)
    for p in parts[1:]:
        cold = cold.union(p.select(*shape.names))
    n = cold.count()
    bins = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // BIN_RUNS)
    columns = ["doc_id", "print", "first", "last", "anchor", "run", "key", "body"]
    sorted_bins = cold.select(*columns, F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin")).groupBy("bin")
    local = sorted_bins.applyInPandas(_bin(length), "doc_id long, print long, lo long, hi long, earlier boolean")
    return whole.union(local)


def _merge(rows: list[dict], length: int, data: bytes, whole_characters: bool) -> list[tuple[int, int]]:
    spans: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + length) for r in rows):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    if whole_characters:  # a span gives up the pieces of characters at its ends
        for s in spans:
            while s[0] < s[1] and data[s[0]] & 0xC0 == 0x80:
                s[0] += 1
            while s[0] < s[1] < len(data) and data[s[1]] & 0xC0 == 0x80:
                s[1] -= 1
    return [(a, b) for a, b in spans if a < b]


def _apply(length: int, whole_characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, shas, kept, spans = [], [], [], [], [], []
            for text, rows in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                cut = _merge(rows.as_py() or [], length, data, whole_characters)
                rest, at = [], 0
                for a, b in cut:
                    rest.append(data[at:a])
                    at = b
                rest.append(data[at:])
                left = b"".join(rest)
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(left))
                n_spans.append(len(cut))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "strict" if whole_characters else "ignore"))
                spans.append([{"start": a, "end": b} for a, b in cut])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                    pa.array(shas, pa.string()), pa.array(kept, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"],
            )

    return run


def _with_intervals(docs: DataFrame, doc_id: str, text: str, length: int, earlier: bool, hot_runs: int) -> DataFrame:
    """``row`` (a struct c0, c1, ... of all columns of ``docs`` but the text, so that no name can clash), ``text`` and the list ``found`` of repeated starts."""
    rest = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]).alias("row")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # the text crosses the network once, and by the same kind of join at every size
    keyed = docs.select(rest, F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(t).alias("print"), F.col(f"`{text}`").alias("text"))
    found = intervals(keyed.select("doc_id", "print", F.coalesce("text", F.lit("")).alias("text")), length, hot_runs)
    found = found.where(F.col("earlier") == F.lit(earlier)).groupBy(F.col("doc_id").alias("fid"), F.col("print").alias("fprint"))
    found = staged(found.agg(F.collect_set(F.struct("lo", "hi")).alias("found")), "repeated")
    return keyed.join(found.hint("merge"), (F.col("doc_id") == F.col("fid")) & (F.col("print") == F.col("fprint")), "left").select("row", "text", "found")


def _result(doc_id: DataType) -> StructType:
    spans = StructType().add("start", "long").add("end", "long")
    kind = StructType().add("doc_id", doc_id).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    return kind.add("kept_sha256", "string").add("kept_text", "string").add("spans", ArrayType(spans))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = 400, earlier: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (of the input), n_removed, n_spans, kept_sha256, ``kept_text`` and the removed ``spans`` in bytes.

    Every byte covered by a ``min_bytes`` string that also starts elsewhere is removed; with ``earlier`` only strings
    that start at an earlier place are, so the first copy stays. ``kept_text`` is what remains, without the pieces of
    characters that a cut leaves; kept_sha256 is of all remaining bytes. Null counts as empty; matches do not cross rows. Rows
    equal in id and text are copies of each other, but have one place (so ``earlier`` keeps both). Other columns are not
    read.
    """
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = _with_intervals(named, "doc_id", "text", min_bytes, earlier, hot_runs).select(F.col("row.c0").alias("doc_id"), "text", "found")
    return found.mapInArrow(_apply(min_bytes, False), _result(LongType()))


def drop_later_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = 400, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``docs`` with later copies cut out of ``text``, whole characters only; all other columns and rows stay as they are."""
    found = _with_intervals(docs, doc_id, text, min_bytes, True, hot_runs)
    same = found.where("found is null").select("row", "text")
    # the text goes through the kernel with the rest of the row beside it
    cut = found.where("found is not null").select(F.col("row").alias("doc_id"), "text", "found")
    out = cut.mapInArrow(_apply(min_bytes, True), _result(cut.schema["doc_id"].dataType))
    whole = same.unionByName(out.select(F.col("doc_id").alias("row"), F.col("kept_text").alias("text")))
    return whole.select(*[(F.col("text") if c == text else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])
