"""Clusters of integer vectors: rounds of exact nearest-centroid assignment through a vantage-point tree.

Each round the driver builds a vantage-point tree over the ``k`` centroids and sends it to every task (``k`` times the
number of components, whatever the table's size). A vector walks the tree best first: its open nodes by lower bound on
the distance to anything inside, the radius being the distance to the best centroid so far. Nodes at a bound equal to the
radius are still opened, for they may hold an equally near centroid with a smaller number. Distances to vantage points and
in leaves are exact integers; only the bounds are floating point, and they are lowered by more than their error.

All vectors of a batch walk together: vectors whose nearest open node is the same are measured against it at once.

Tasks return sums and counts for each centroid, so a round shuffles at most ``k`` rows for each task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import staged

#: Centroids of a leaf, at most.
LEAF = 4
#: Vectors of a batch; they hold one bound for each node of the tree.
ROWS = 4096
#: Components up to this size keep squared distances of a few thousand components within 64 bits; larger ones are
#: worked on as Python integers.
FAST = 1 << 24
LONG = (1 << 63) - 1
#: Bound of the components, so that sums over all vectors fit in 38 digits.
LIMIT = 10**26


class Tree:
    """Vantage-point tree over the rows of ``centroids`` (integers)."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF) -> None:
        self.centroids, self.leaf = centroids, leaf
        #: of each node: its centroids if it is a leaf, else (vantage point, inner child, its least and largest
        #: distance from that point, outer child, the same)
        self.nodes: list[np.ndarray | tuple] = []
        self._build(np.arange(len(centroids)))

    def _build(self, members: np.ndarray) -> int:
        me = len(self.nodes)
        self.nodes.append(members)
        if len(members) <= self.leaf:
            return me
        # the vantage point is the member farthest from the first one; ties by number
        far = _squares(self.centroids[members], self.centroids[members[0]])
        point = members[int(np.argmax(far))]
        rest = members[members != point]
        away = np.sqrt(_squares(self.centroids[rest], self.centroids[point]).astype(np.float64))
        order = np.argsort(away, kind="stable")
        half = len(rest) // 2
        sides = []
        for part in (order[:half], order[half:]):
            sides += [self._build(np.sort(rest[part])), away[part].min(), away[part].max()]
        self.nodes[me] = (point, *sides)
        return me

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid of each vector (the smallest of equally near ones), the squared distance, and
        how many distances were measured."""
        n, k = len(vectors), len(self.centroids)
        best = np.full(n, -1, vectors.dtype)
        which = np.full(n, k, np.int64)
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0.0
        live = np.arange(n)
        measured = 0

        def offer(rows: np.ndarray, number: int, square: np.ndarray) -> None:
            nearer = (best[rows] < 0) | (square < best[rows]) | ((square == best[rows]) & (number < which[rows]))
            best[rows[nearer]], which[rows[nearer]] = square[nearer], number

        while True:
            node = bound[live].argmin(1)
            low = bound[live, node]
            reached = best[live].astype(np.float64)
            radius = np.where(reached < 0, np.inf, np.sqrt(np.abs(reached)))
            go = np.isfinite(low) & (low <= radius)
            live, node = live[go], node[go]
            if not len(live):
                return which, best, measured
            order = np.argsort(node, kind="stable")
            here, limits = np.unique(node[order], return_index=True)
            for at, a, b in zip(here, limits, np.append(limits[1:], len(live)), strict=True):
                rows, inside = live[order[a:b]], self.nodes[at]
                above = bound[rows, at]
                bound[rows, at] = np.inf
                if isinstance(inside, np.ndarray):
                    for number in inside:
                        offer(rows, int(number), _squares(vectors[rows], self.centroids[number]))
                    measured += len(rows) * len(inside)
                    continue
                point, inner, in_low, in_high, outer, out_low, out_high = inside
                square = _squares(vectors[rows], self.centroids[point])
                measured += len(rows)
                offer(rows, int(point), square)
                d = np.sqrt(square.astype(np.float64))
                for child, near, far in ((inner, in_low, in_high), (outer, out_low, out_high)):
                    # lowered by far more than the rounding of square roots and differences
                    gap = np.maximum(d - far, near - d) - 1e-9 * (d + far)
                    bound[rows, child] = np.maximum(np.maximum(gap, above), 0.0)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return (gap * gap).sum(-1)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of 64-bit integers, or of Python integers when a component is large."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.dtype == np.float64:
        flat = _whole(flat)
    return flat.reshape(-1, dims)


def _whole(values) -> np.ndarray:
    out = np.array([math.floor(v) for v in values], object)
    if max(map(abs, out), default=0) >= LIMIT:
        raise ValueError(f"a scaled component has {len(str(LIMIT))} digits or more")
    return out


def _batches(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of rows with their vectors; vectors with large components come by themselves, as Python integers."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        narrow = part.column("large").is_null()
        for rows, name in ((part.filter(narrow), "parts"), (part.filter(part.column("large").is_valid()), "large")):
            if rows.num_rows:
                yield rows, _vectors(rows.column(name), dims)


def _measure(centroids: np.ndarray, vectors: np.ndarray, trees: dict) -> tuple[np.ndarray, np.ndarray]:
    wide = vectors.dtype == object or centroids.dtype == object
    if wide not in trees:
        trees[wide] = Tree(centroids.astype(object) if wide else centroids)
    which, square, _ = trees[wide].nearest(vectors.astype(object) if wide else vectors)
    return which, square


def _sums(centroids: np.ndarray, dims: int):
    k = len(centroids)
    kind = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict = {}
        n, sums = np.zeros(k, np.int64), [[0] * dims for _ in range(k)]
        for batch in batches:
            for _, vectors in _batches(batch, dims):
                which, _ = _measure(centroids, vectors, trees)
                for c in np.unique(which):
                    mine = vectors[which == c]
                    n[c] += len(mine)
                    sums[c] = [a + int(b) for a, b in zip(sums[c], mine.sum(0), strict=True)]
        met = np.flatnonzero(n)
        if len(met):
            yield pa.RecordBatch.from_pydict({"cluster": met.astype(np.int32), "n": n[met], "sums": pa.array([sums[c] for c in met], kind.field("sums").type)}, kind)

    return run


def _assign(centroids: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict = {}
        for batch in batches:
            for rows, vectors in _batches(batch, dims):
                which, square = _measure(centroids, vectors, trees)
                fits = [int(s) if s <= LONG else None for s in square] if square.dtype == object else square
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(which.astype(np.int32)), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _array(vectors: list[list[int]]) -> np.ndarray:
    large = any(abs(c) > FAST for v in vectors for c in v)
    return np.array(vectors, object if large else np.int64)


def _long(n) -> int | None:
    """A whole number of 64 bits, else None."""
    return int(n) if n is not None and n <= LONG else None


def integers(vectors: DataFrame, dims: int, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and the vectors of ``dims`` finite components: ``parts``, floor(scale * x), or beyond FAST ``large``, scale * x."""
    x: Column = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") == dims) & finite)
    scaled = F.transform("x", lambda v: v * float(scale))
    fast = F.forall(scaled, lambda v: F.abs(v) < float(FAST))
    parts = F.when(fast, F.transform(scaled, lambda v: F.floor(v)))
    return kept.select("vec_id", parts.cast("array<long>").alias("parts"), F.when(~fast, scaled).alias("large"))


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null or not finite, as integers floor(scale * x). Centroids
    start as the kept vectors with the smallest sha256 of ``salt`` and id; a null id counts as no digits, equal hashes
    (repeated ids) go by their components. With fewer kept vectors than ``k`` all of them start one. Of equally near
    centroids the smaller number wins, so of equal centroids only the first gets vectors; centroids that get none stay.
    Repeated rows are vectors of their own. A table without kept vectors gives no rows. Scaled components beyond 2**24
    are worked on, slower, as Python integers; ones of 10**26 or more are an error; a distance or inertia beyond 64 bits is
    null, and so is an inertia with such a distance in it. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = staged(integers(vectors, dims, scale, vec_id, embedding), "vectors")
    start = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(start.alias("hash"), "parts", "large").orderBy("hash", "parts", "large").limit(k).collect()  # k rows
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], shape)
    centroids = [[int(c) for c in (_whole(r["large"]) if r["parts"] is None else r["parts"])] for r in first]
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(_array(centroids), dims), "cluster int, n long, sums array<decimal(38,0)>")
        total = sums.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)))
        for r in total.collect():  # at most k rows
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    found = staged(rows.select("vec_id", "parts", "large").mapInArrow(_assign(_array(centroids), dims), "vec_id long, cluster int, distance long"), "assigned")
    exact = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(exact.alias("inertia")).collect()}  # at most k rows
    inertia = {c: _long(n) for c, n in sums.items()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole = None if None in sums.values() else _long(sum(sums.values()))
    of_cluster = spark.createDataFrame(
        [(c, inertia[c], whole, digests[c]) for c in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.join(F.broadcast(of_cluster), "cluster").select(*(f.split(" ")[0] for f in shape.split(", ")))
