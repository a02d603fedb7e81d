"""Best-fit packing, planned on a histogram of lengths.

1. Every document is tokenised once. Its tokens are cut into pieces of at most ``length``; only the first may be shorter.
   Pieces (without texts and ids) are written with their rank among the pieces of one length in their own file part.
2. Best fit, longest first, runs over the counts of the lengths, not over documents: equal sequences are kept as one
   run with a count. There are at most ``length`` lengths, so the plan and the work for it do not grow with the table.
3. A piece's rank within its length (the counts of earlier parts plus its own rank) says which planned slot it takes.

Nothing is grouped by length or by sequence: a length that a third of all pieces share is a few rows of the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm import bpe
from docketry.llm.common import small
from docketry.session import staged

#: Parts whose counts are added up in one step of the running sum over parts.
PART_BLOCK = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long"


def plan(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Slots for ``counts`` pieces of each length in sequences of ``length``: best fit, longest first.

    Rows (piece length, first rank, first sequence, pieces in each sequence, offset of the first): the pieces from that
    rank on fill the sequences from that number on, so many in each, one behind the other. Sequences with the same room
    are runs of consecutive numbers; a length takes whole runs of the tightest room, splitting one run at most.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, sequences)
    rows: list[tuple[int, int, int, int, int]] = []
    used = 0

    def settle(first: int, n: int, room: int) -> None:
        if n and room:
            runs.setdefault(room, []).append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = min((r for r in runs if r >= size), default=None)
            if room is None:
                room, each = length, length // size
                first, n = used, -(-left // each)
                used += n
            else:
                each = room // size
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
            rows.append((size, rank, first, each, length - room))
            full = min(n, left // each)
            settle(first, full, room - each * size)
            took, rest = full * each, 0
            if full < n and left > took:  # the last sequence of the run gets fewer
                rest = left - took
                settle(first + full, 1, room - rest * size)
            settle(first + full + bool(rest), n - full - bool(rest), room)
            left, rank = left - took - rest, rank + took + rest
    return rows


def _cut(path: str, end_id: int, length: int, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "part", "part_rank"))]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = bpe.load(path), np.array([end_id], np.uint32)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc = doc.as_py()
                ids = np.concatenate([tokens.encode(text.as_py() or ""), end]).astype("<u4")
                n = len(ids)
                start, piece = 0, 0
                stop = n % length or length
                while start < n:
                    size = stop - start
                    row = [doc, piece, start, size, zlib.crc32(ids[start:stop].tobytes()), n, part, int(seen[size])]
                    if with_ids:
                        row.append(ids[start:stop].astype(np.int32))
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                    seen[size] += 1
                    start, stop, piece = stop, stop + length, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _take(rows: list[tuple[int, int, int, int, int]], n_kept: int):
    """Sequence and offset of each piece, from its length and rank."""
    size, first_rank, first_seq, each, base = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    order = np.lexsort((first_rank, size))
    size, first_rank, first_seq, each, base = (c[order] for c in (size, first_rank, first_seq, each, base))
    # rows of one length in a slice; the row of a rank is found in it
    low, high = (np.searchsorted(size, np.arange(size.max() + 1), side) for side in ("left", "right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.zeros(len(length), np.int64)
            for s in np.unique(length):
                mine = length == s
                at[mine] = low[s] + np.searchsorted(first_rank[low[s] : high[s]], rank[mine], "right") - 1
            j = rank - first_rank[at]
            columns = [*batch.columns[:n_kept], pa.array(first_seq[at] + j // each[at]), pa.array(base[at] + j % each[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:n_kept], "sequence_id", "offset"])

    return run


def _before(counts: DataFrame) -> DataFrame:
    """Pieces of a length in the parts before each part, from (length, part, n); sums of blocks of parts come first."""
    rows = counts.withColumn("block", F.floor(F.col("part") / PART_BLOCK).cast("long"))
    blocks = rows.groupBy("length", "block").agg(F.sum("n").alias("n"))
    over = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.select("length", "block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(ahead, ["length", "block"]).select("length", "part", (F.col("ahead") + F.col("inside")).alias("before"))


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = 1024, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids``).

    A document's ids are those of its text and then ``end_id``; a null or empty text has that one id. Null and repeated
    ids are rows like any other; equal rows take different slots. Other columns, whatever their names, are not read. An
    empty table gives an empty one. The plan depends on the counts of the lengths alone; which of two pieces of one
    length takes which slot depends on how the table is read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = PIECES + ", part long, part_rank long" + (", ids array<int>" if with_ids else "")
    pieces = staged(rows.mapInArrow(_cut(tokenizer, end_id, length, with_ids), kind), "pieces")
    counts = staged(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``length`` rows
    kept = [c.split(" ")[0] for c in PIECES.split(", ")] + (["ids"] if with_ids else [])
    shape = PIECES + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    if not histogram:
        return spark.createDataFrame([], shape)
    before = staged(_before(counts), "ranks")
    ranked = pieces.join(small(before), ["length", "part"]).select(*kept, (F.col("before") + F.col("part_rank")).alias("rank"))
    return ranked.mapInArrow(_take(plan(histogram, length), len(kept)), shape)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, tokens and its ids in order, from ``pack(..., with_ids=True)``."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.flatten(F.transform(inside, lambda p: p["ids"])).alias("ids"))
