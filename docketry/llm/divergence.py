"""Audit of how the sources of a language differ in their words.

1. In each task, texts are taken in slices of whole rows. Pointers to the starts of the terms of a slice (in the Arrow
   bytes, A-Z lower-cased) are sorted by multikey quicksort with symbols of eight bytes: pointers are ordered by one
   symbol, and only runs of equal pointers go on to the next one. Equal runs at the end are terms; the length of a run is
   the term's count, its distinct rows are the document frequency.
2. Counts of (lang, source, term) are added up by Spark, with a partial sum before the shuffle. Frequencies of (lang,
   term) keep the terms of at least ``MIN_DOCS`` documents.
3. Smoothed shares are integers, so every figure is exact.
4. Pairs of sources: a term is in no more rows than it has sources, and pairs are never joined. Buckets of terms are
   shuffled to tiles of at most about TILE x TILE pairs; a task adds up a whole tile in one matrix and gives out its sums.
   Terms that neither source has all differ alike and are counted, not visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import TO_LOWER, blocks, class_bounds, small
from docketry.session import staged

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Text bytes of a slice, about; a longer text is a slice of its own.
SLICE = 8 << 20
#: Sources of a tile's side and counts of a bucket, about.
TILE, BUCKET = 256, 200_000
#: Symbols after which the rests of long terms with an equal front are compared as a whole.
SYMBOLS = 8

_LETTERS = np.zeros(256, np.uint8)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = 1
_FRONT = np.array([0] + [((1 << (8 * n)) - 1) << (64 - 8 * n) for n in range(1, 9)], np.uint64)


def _symbols(view: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The next eight bytes of each pointer as a number, zero behind the term's end (no term holds a zero byte)."""
    key = view[np.minimum(at, len(view) - 1)].view(">u8").ravel().astype(np.uint64)
    return key & _FRONT[np.clip(end - at, 0, 8)]


def sort_pointers(buf: np.ndarray, s: np.ndarray, e: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by (group, term) and, for each in that order, whether it starts a new run of equal ones.

    Pointers that are equal keep their order.
    """
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(8, np.uint8)]), 8)
    key = _symbols(view, s, e)
    order = np.lexsort((key, group))
    new = np.ones(len(s), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (key[order][1:] != key[order][:-1])
    depth = 8
    while True:
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        alone = np.diff(np.append(first, len(s))) == 1
        # pointers in a run with others; the longer ones (or ones as long) still differ or not in what follows
        open_ = np.flatnonzero(~alone[run])
        longest = np.zeros(len(first), bool)
        more = e[order[open_]] - s[order[open_]] > depth
        longest[run[open_[more]]] = True
        open_ = open_[longest[run[open_]]]
        if not len(open_):
            return order, new
        mine = order[open_]
        if depth < 8 * SYMBOLS:
            key = _symbols(view, s[mine] + depth, e[mine])
        else:  # long terms: a number for each distinct rest, in byte order
            rests = [buf[a + depth : max(a + depth, b)].tobytes() for a, b in zip(s[mine], e[mine], strict=True)]
            number = {rest: i for i, rest in enumerate(sorted(set(rests)))}
            key = np.array([number[rest] for rest in rests], np.uint64)
        again = np.lexsort((key, run[open_]))
        order[open_] = mine[again]
        key, part = key[again], run[open_]
        new[open_[1:]] |= (key[1:] != key[:-1]) & (part[1:] == part[:-1])
        if depth >= 8 * SYMBOLS:
            return order, new
        depth += 8


def _slice_counts(langs: list, sources: list, buf: np.ndarray, offs: np.ndarray) -> tuple[list, list, pa.Array, np.ndarray, np.ndarray]:
    """lang, source, term, count and documents of every run of a slice."""
    buf = TO_LOWER[buf]
    s, e, row = class_bounds(buf, offs, _LETTERS)
    names: dict[tuple[str, str], int] = {}
    of_row = np.array([names.setdefault(pair, len(names)) for pair in zip(langs, sources, strict=True)], np.int64)
    group = of_row[row]
    order, new = sort_pointers(buf, s, e, group)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    rows = row[order]  # ascending inside a run
    changes = new.copy()
    changes[1:] |= rows[1:] != rows[:-1]
    docs = np.add.reduceat(changes.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    head = order[first]
    size = e[head] - s[head]
    to = np.zeros(len(head) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    data = buf[np.repeat(s[head] - to[:-1], size) + np.arange(to[-1])]
    terms = pa.LargeStringArray.from_buffers(len(head), pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(data)))
    pairs = list(names)
    return [pairs[g][0] for g in group[head]], [pairs[g][1] for g in group[head]], terms, count, docs


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ["lang", "source", "term", "n", "docs"]
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, j, buf, offs in blocks(batch.column(2), SLICE):
            lang, source, term, n, docs = _slice_counts(langs[i:j], sources[i:j], buf, offs)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), term.cast(pa.string()), pa.array(n), pa.array(docs)], columns)


def _share(count: Column, total: str = "total") -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return (F.call_function("div", scaled, (F.col(total) + F.col("terms")).cast("decimal(19,0)")) + 1).cast("long")


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q).cast("long")


def _tile(data: pd.DataFrame, own: pd.DataFrame, other: pd.DataFrame) -> np.ndarray:
    """For each pair of an own and another source: the sum over the terms of ``data``, less what terms of neither give."""
    p0, q0 = own["p0"].to_numpy(), other["p0"].to_numpy()
    total = np.zeros((len(p0), len(q0)), np.int64)
    at_own = pd.Index(own["source"]).get_indexer(data["source"])
    at_other = pd.Index(other["source"]).get_indexer(data["source"])
    side, p = data["own"].to_numpy(), data["p"].to_numpy()
    term = pd.factorize(data["term"])[0]
    n = int(term.max()) + 1 if len(term) else 0
    step = max(1, 4_000_000 // max(1, len(p0) * len(q0)))
    order = np.argsort(term, kind="stable")
    limits = np.searchsorted(term[order], np.arange(0, n + step, step))
    base = _int_gap(p0[:, None], q0[None, :])
    for k, (a, b) in enumerate(zip(limits[:-1], limits[1:], strict=True)):
        here = order[a:b]
        width = min(step, n - k * step)
        mine, its = np.repeat(p0[None, :], width, 0), np.repeat(q0[None, :], width, 0)
        rows, cols = here[side[here]], here[~side[here]]
        mine[term[rows] - k * step, at_own[rows]] = p[rows]
        its[term[cols] - k * step, at_other[cols]] = p[cols]
        total += _int_gap(mine[:, :, None], its[:, None, :]).sum(0) - width * base
    return total


def _int_gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _sum_tile(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
    """Sums of one bucket of terms of one tile; rows without a term list the tile's sources."""
    listed = data[data["term"].isna()]
    own, other = listed[listed["own"]].reset_index(drop=True), listed[~listed["own"]].reset_index(drop=True)
    total = _tile(data[data["term"].notna()], own, other)
    i, j = (x.ravel() for x in np.indices(total.shape))
    out = pd.DataFrame({"lang": key[0], "source": own["source"].to_numpy()[i], "item": other["source"].to_numpy()[j], "value": total.ravel()})
    return out[out["source"] != out["item"]]


def _pairs(groups: DataFrame, kept: DataFrame, tiles: int, buckets: int) -> DataFrame:
    """(lang, source, item, value) for every two sources of a lang."""

    def sided(rows: DataFrame, term: Column, p: Column, bucket: Column) -> DataFrame:
        """Each row once for every tile that its source is in, as the own and as the other side."""
        mine, every = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
        out = rows.select("lang", "source", term.alias("term"), p.alias("p"), "p0", bucket.alias("bucket"), mine.alias("mine"), every.alias("every"))
        a = out.select("lang", F.col("mine").alias("row"), F.col("every").alias("col"), "bucket", F.lit(True).alias("own"), "source", "term", "p", "p0")
        return a.union(out.select("lang", F.col("every").alias("row"), F.col("mine").alias("col"), "bucket", F.lit(False).alias("own"), "source", "term", "p", "p0"))

    # every tile and bucket needs the list of its sources: groups x tiles x buckets rows, few beside the counts
    listed = groups.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    listed = sided(listed, F.lit(None).cast("string"), F.lit(None).cast("long"), F.col("at"))
    counts = sided(kept, F.col("term"), F.col("p"), F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    sums = counts.union(listed).groupBy("lang", "row", "col", "bucket").applyInPandas(_sum_tile, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources are from each other, and their most marked terms.

    Part ``pair``: the sum over all kept terms for every other source of the lang. Part ``term``: terms a source has more
    than its lang does, up to rank ``top``. Null texts, langs and sources are ''. Terms are runs of letters of ASCII and
    of any other characters beyond ASCII, only A-Z lower-cased; a lang keeps terms of at least ``min_docs`` of its rows.
    A row is a document, whether or not its id or its text repeats. A lang without kept terms gives pairs of value 0; an
    empty table gives none. Ranks break ties by the item's bytes. Other columns are not read.
    """
    filled = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    rows = docs.select(*filled)
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = staged(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    terms = staged(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "kept")
    kept = staged(counts.drop("docs").join(terms, ["lang", "term"]), "counts")

    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    pairs_of = rows.select("lang", "source").distinct()
    groups = pairs_of.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")))
    # without a kept term there is nothing to sum; the share is then never used
    groups = groups.withColumn("p0", F.when(F.col("terms") > 0, _share(F.lit(0))).otherwise(F.lit(1)))
    groups = staged(groups, "groups")

    shared = kept.join(small(groups), ["lang", "source"])
    shared = shared.withColumn("p", _share(F.col("n"))).withColumn("q", _share(F.col("lang_n"), "lang_total"))

    marked = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marked = marked.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    tiles = max(1, -(-most // TILE))
    buckets = max(1, -(-(kept.count() * 2) // BUCKET))
    seen = _pairs(groups, shared, tiles, buckets)
    # terms that neither source has: the same gap for each
    own, other = groups.alias("a"), groups.alias("b")
    base = seen.join(small(own.select("lang", "source", "p0", "terms")), ["lang", "source"]).join(
        small(other.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))), ["lang", "item"]
    )
    pairs = base.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.col("terms") * _gap(F.col("p0"), F.col("q0"))).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(marked)
