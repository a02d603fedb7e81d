"""Embedding near-duplicates with an inverted multi-index.

1. Unit vectors are cut in two halves; each half has its own codebook, trained on a bounded sample. A pair of words,
   one of each book, is a cell of the product grid; every vector is stored in one cell of its label.
2. A query visits cells by multi-sequence traversal: in order of the sum of its halves' squared distances. For each
   word there is a lower bound on the squared distance from the query's half to any half that has that word as its
   nearest; cells whose two bounds together allow a link are visited, nearest first, until they hold the target recall.
   With target recall 1 (the default) all of them are visited, so no link is missed.
3. Cells are cut into blocks of vectors and of queries; a task compares one block with another in double precision and
   returns link counts and a spanning set of the links, never the pairs.

Vectors that are equal number for number count as one, with their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import components, small
from docketry.session import staged

SAMPLE, BLOCK = 20_000, 1024
#: Vectors for which the product grid has one cell, about; a codebook has the square root of the number of cells.
CELL = 2000


def train(sample: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """Codebook of ``words`` centres by Lloyd's rounds from evenly spaced rows."""
    words = max(1, min(words, len(sample)))
    centres = sample[np.linspace(0, len(sample) - 1, words).astype(int)].copy()
    for _ in range(rounds):
        near = _squares(sample, centres).argmin(axis=1)
        for k in range(words):
            if (near == k).any():
                centres[k] = sample[near == k].mean(axis=0)
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T, 0)


def half_bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to the centres, and a lower bound on the squared distance to any point nearest to each centre.

    A point nearest to centre v is not beyond the plane halfway between v and any other centre u, so its distance from
    x is at least x's distance to that plane when x lies on u's side; u is x's own nearest centre here.
    """
    d = _squares(x, centres)
    own = d.argmin(axis=1)
    gap = np.sqrt(_squares(centres, centres))[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d - d[np.arange(len(x)), own][:, None]) / (2 * gap)
    plane[~np.isfinite(plane) | (gap == 0)] = 0
    return d, np.maximum(plane, 0) ** 2


def cells_of(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], reach: float, recall: float = 1.0) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cell that stores each vector, and the cells it visits as a query, nearest first.

    ``reach`` is the largest squared distance of a link. With ``recall`` below 1 a query stops once the visited share
    of the weights exp(-distance) of its admissible cells reaches it.
    """
    cut = x.shape[1] // 2
    (d1, b1), (d2, b2) = half_bounds(x[:, :cut], books[0]), half_bounds(x[:, cut:], books[1])
    own = d1.argmin(1) * len(books[1]) + d2.argmin(1)
    visits = []
    for i in range(len(x)):
        ok = np.flatnonzero((b1[i][:, None] + b2[i][None, :]).reshape(-1) <= reach)
        far = (d1[i][:, None] + d2[i][None, :]).reshape(-1)[ok]
        ok = ok[np.argsort(far, kind="stable")]
        if recall < 1:
            share = np.cumsum(np.exp(-np.sort(far) / max(reach, 1e-12)))
            ok = ok[: int(np.searchsorted(share, recall * share[-1])) + 1]
        visits.append(np.union1d(ok, own[i]) if own[i] not in ok else ok)
    return own, visits


def _place(books: dict[int, tuple[np.ndarray, np.ndarray]], reach: float, recall: float):
    """Cells by the books of a vector's length; vectors of a length that the sample lacks share one cell."""

    def run(batches):
        for pdf in batches:
            for size, same in pdf.groupby(pdf.unit.map(len)):
                for at in range(0, len(same), 2048):
                    part = same.iloc[at : at + 2048]
                    if size in books:
                        own, visits = cells_of(np.stack(part.unit.to_numpy()).astype(np.float64), books[size], reach, recall)
                    else:
                        own, visits = np.zeros(len(part), np.int64), [np.zeros(1, np.int64)] * len(part)
                    yield part.assign(cell=own.astype(np.int64), visits=visits)

    return run


def _spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """(left, vertex, whether it is a right one): pairs that keep connected what ``links`` (left by right) connects.

    Every row and column of ``links`` must have a link.
    """
    label = np.arange(links.shape[0])
    big = links.shape[0]
    while True:
        down = np.where(links, label[:, None], big).min(0)
        new = np.minimum(label, np.where(links, down[None, :], big).min(1, initial=big))
        if (new == label).all():
            break
        label = new
    return [(int(label[i]), i, 0) for i in range(len(label)) if label[i] != i] + [(int(down[j]), j, 1) for j in range(len(down))]


def _compare(threshold: float):
    def run(queries: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(stored):
            return pd.DataFrame({"vec": [], "n": [], "a": [], "b": []})
        q, s = (np.stack(p.unit.to_numpy()).astype(np.float64) for p in (queries, stored))
        qv, sv = queries.vec.to_numpy(np.int64), stored.vec.to_numpy(np.int64)
        links = (q @ s.T >= threshold) & (qv[:, None] != sv[None, :])
        rows, cols = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
        n = links[rows] @ stored.copies.to_numpy(np.int64)
        qs, ss = qv[rows], sv[cols]
        span = _spanning(links[np.ix_(rows, cols)]) if len(rows) else []
        a = [qs[i] for i, _, _ in span]
        b = [(ss if right else qs)[j] for _, j, right in span]
        return pd.DataFrame({"vec": np.append(qv[rows], a), "n": np.append(n, np.zeros(len(a), np.int64)), "a": np.append(qv[rows], a), "b": np.append(qv[rows], b)}).astype("int64")

    return run


def classes(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98,
    words: int | None = None, sample: int = SAMPLE, recall: float = 1.0, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept.

    Vectors of one label that is not null link when their cosine is at least ``threshold``. Null and zero vectors, and
    vectors with null, infinite or NaN components, link with nothing; vectors of different lengths do not link. ``sample`` bounds the vectors that train the codebooks (those with the smallest hashes);
    all vectors are indexed and all are queries. ``words`` is the size of a codebook; by default it follows the number of
    vectors. Other columns are not read.
    """
    spark = table.sparkSession
    wide = F.col(f"`{embedding}`").cast("array<double>")
    rows = table.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), wide.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("peak", F.when(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad, F.array_max(F.transform("v", F.abs))))
    # scaled by the largest component first, so squares neither overflow nor vanish
    scaled = F.transform("v", lambda x: x / F.col("peak"))
    rows = rows.withColumn("v", F.when(F.col("peak") > 0, scaled)).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    rows = rows.withColumn("unit", F.transform("v", lambda x: x / F.col("length")))
    # vectors of one label and length are compared; the length ends the label, so no two pairs of them read the same
    rows = rows.withColumn("label", F.concat("label", F.lit(":"), F.size("unit").cast("string")))
    rows = rows.withColumn("vec", F.when(F.col("unit").isNotNull(), F.xxhash64("label", "unit"))).select("vec_id", "label", "unit", "vec")
    rows = staged(rows, "vectors")
    own = rows.where("vec is not null").groupBy("vec").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    own = staged(own, "distinct_vectors")
    drawn = [r[0] for r in own.orderBy(F.xxhash64("vec")).limit(sample).select("unit").collect()]
    result = rows.select("vec_id", "vec")
    if drawn:
        if words is None:
            words = int(np.clip(np.sqrt(own.count() / CELL), 2, 256))
        books = {}
        for size in {len(v) for v in drawn}:
            same = np.array([v for v in drawn if len(v) == size])
            books[size] = (train(same[:, : size // 2], words), train(same[:, size // 2 :], words))
        reach = 2 - 2 * threshold + 1e-9
        placed = own.select("vec", "label", "unit", "copies").mapInPandas(
            _place(books, reach, recall), "vec long, label string, unit array<double>, copies long, cell long, visits array<long>"
        )
        placed = staged(placed, "cells")
        stored = placed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("stored"))
        asked = placed.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").agg(F.count(F.lit(1)).alias("asked"))
        sizes = stored.join(asked, ["label", "cell"]).select("label", "cell", F.ceil(F.col("stored") / block).alias("sb"), F.ceil(F.col("asked") / block).alias("qb"))
        sizes = small(staged(sizes, "cell_sizes"))
        mine = F.pmod(F.xxhash64("vec", F.lit(1)), F.col("sb"))
        store = placed.join(sizes, ["label", "cell"]).select("label", "cell", mine.alias("s"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "vec", "unit", "copies")
        asks = placed.select("label", "unit", "vec", F.explode("visits").alias("cell")).join(sizes, ["label", "cell"])
        asks = asks.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("s"), F.pmod(F.xxhash64("vec", F.lit(2)), F.col("qb")).alias("q"), "vec", "unit")
        key = ["label", "cell", "s", "q"]
        store = store.toDF("label2", "cell2", "s2", "q2", "vec", "unit", "copies")  # names of its own, or the two sides are confused
        met = asks.groupBy(*key).cogroup(store.groupBy("label2", "cell2", "s2", "q2")).applyInPandas(_compare(threshold), "vec long, n long, a long, b long")
        met = staged(met, "met")
        links = met.groupBy("vec").agg(F.sum("n").alias("n"))
        comps = components(spark, met.where("a <> b").select("a", "b"))
        named = own.select("vec", "least", "copies").join(links, "vec", "left").join(comps.withColumnRenamed("node", "vec"), "vec", "left")
        named = named.withColumn("comp", F.coalesce("comp", "vec"))
        heads = named.groupBy("comp").agg(F.min("least").alias("component_id"))
        names = named.where("copies > 1 or n > 0").join(heads, "comp").select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        result = result.join(small(staged(names, "named_vectors")), "vec", "left")
    else:
        result = result.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")})
    comp = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(True)).alias("kept"))
