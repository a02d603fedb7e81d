"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes a set of distinct word shingles; texts with one set share a node (their set's fingerprint).
2. A node has ``bands * rows`` MinHash values. Nodes that agree on all rows of a band share a bucket.
3. In every bucket one node, the pivot, is paired with the others, so a bucket of m nodes gives m - 1 pairs. Where the
   links found leave a bucket in several components, its nodes of different components are paired if they still can
   link. In a bucket of up to ``FEW`` nodes all such nodes are. In a larger one each node is measured exactly against the
   pivot: from sizes and from what two nodes share with the pivot follows how many of their differences to it they must
   have in common to link, and they meet by those. A pair is only left out when its ends are connected already or cannot link.
4. Pairs compare their signatures batch by batch; a pair goes when the posterior probability that its similarity
   reaches the threshold falls below ``miss``.
5. What remains is compared on the full shingle sets, from the whole texts.

With 24 bands of 4 rows a pair at 0.8 shares no bucket with probability 3e-6, and less above.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.common import U64, ascii_lower, blocks, components, fixed_binary, mix, shingles, signed, small, word_bounds, word_prints
from docketry.session import staged

BANDS, ROWS = 24, 4
MISS = 1e-6
BATCH = 24
#: Nodes of a bucket that are compared all with all.
FEW = 16
_rng = np.random.default_rng(7)
MUL = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)
ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def sets_of(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    s, e, row = word_bounds(buf, offs)
    return shingles(word_prints(buf, s, e), row, len(offs) - 1, width)


def node_ids(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """A fingerprint of each set; 0 stands for the empty set alone."""
    out = np.zeros(len(limits) - 1, np.uint64)
    full = limits[1:] > limits[:-1]
    if full.any():
        starts = limits[:-1][full]
        a = np.add.reduceat(mix(values), starts)
        b = np.add.reduceat(mix(values ^ U64(0x5DEECE66D)) * values, starts)
        out[full] = mix(a ^ mix(b)) | U64(1)
    return out


def signatures(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """MinHash values, one row for each set (rows of empty sets mean nothing)."""
    out = np.zeros((len(limits) - 1, len(MUL)), np.uint64)
    full = np.flatnonzero(limits[1:] > limits[:-1])
    i = 0
    while i < len(full):  # slices that stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(limits[full + 1], limits[full[i]] + 32768, "right")))
        lo, hi = limits[full[i]], limits[full[j - 1] + 1]
        starts = limits[full[i:j]] - lo
        part = values[lo:hi]
        for k in range(len(MUL)):
            out[full[i:j], k] = np.minimum.reduceat(part * MUL[k] + ADD[k], starts)
        i = j
    return out


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1)):
                values, limits = sets_of(buf, offs, width)
                sig = signatures(values, limits)
                band = np.zeros((j - i, BANDS), np.uint64)
                for k in range(BANDS):
                    v = np.full(j - i, U64(k + 1))
                    for r in range(ROWS):
                        v = mix(v * U64(3) + sig[:, k * ROWS + r])
                    band[:, k] = v
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(limits), pa.int64()),
                        pa.array(signed(node_ids(values, limits)), pa.int64()),
                        pa.FixedSizeListArray.from_arrays(pa.array(signed(band).reshape(-1), pa.int64()), BANDS).cast(pa.list_(pa.int64())),
                        fixed_binary((mix(sig) & U64(255)).astype(np.uint8)),
                    ],
                    ["doc_id", "n_shingles", "node", "bands", "sig"],
                )

    return run


@lru_cache
def min_matches(percent: int, n: int, miss: float) -> int:
    """Fewest matches among ``n`` one-byte values with which similarity >= percent still has probability >= miss.

    Values match with probability s + (1 - s) / 256 at similarity s; s is uniform beforehand.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    for m in range(n + 1):
        like = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(like - like.max())
        if weight[s >= percent / 100].sum() / weight.sum() >= miss:
            return m
    return n + 1


def _prune(percent: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(MUL)
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, n) for k in (2, 3))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for at in range(0, n, BATCH):
                cut = slice(at, min(at + BATCH, n))
                matches[alive] += (left[alive, cut] == right[alive, cut]).sum(axis=1)
                alive = alive[matches[alive] >= min_matches(percent, cut.stop, miss)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], ["x", "y"])

    return run


def _nodes_of_texts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(0)):
                nodes = node_ids(*sets_of(buf, offs, width))
                yield pa.RecordBatch.from_arrays([pa.array(signed(nodes), pa.int64()), batch.column(0).slice(i, j - i)], ["node", "text"])

    return run


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = list(blocks(batch.column(2))), list(blocks(batch.column(3)))
            sets: list[list[np.ndarray]] = [[], []]
            for side, parts in zip(sets, (left, right), strict=True):
                for i, j, buf, offs in parts:
                    values, limits = sets_of(buf, offs, width)
                    side.extend(values[limits[k] : limits[k + 1]] for k in range(j - i))
            common, linked, differ = [], [], []
            for a, b in zip(*sets, strict=True):
                both = np.isin(b, a, assume_unique=True)
                k = int(both.sum())
                common.append(k)
                linked.append(k > 0 and 100 * k >= percent * (len(a) + len(b) - k))
                differ.append(signed(np.concatenate([b[~both], a[~np.isin(a, b, assume_unique=True)]])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(linked, pa.bool_()), pa.array(differ, pa.list_(pa.int64()))],
                ["x", "y", "common", "linked", "differ"],
            )

    return run


class _Links:
    """The signed rows of one table of texts, and the check of candidate pairs of its nodes."""

    def __init__(self, docs: DataFrame, width: int, percent: int, miss: float) -> None:
        self.width, self.percent, self.miss = width, percent, miss
        self.norm = docs.select(F.col("doc_id"), ascii_lower(F.col("text")).alias("norm"))
        signs = self.norm.mapInArrow(_sign(width), "doc_id long, n_shingles long, node long, bands array<long>, sig binary")
        self.rows = staged(signs, "signatures")
        # texts of one set give one node; any of its equal signatures serves
        nodes = self.rows.where("n_shingles > 0").groupBy("node").agg(
            F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
        )
        self.nodes = staged(nodes, "nodes")
        self.in_bands = self.nodes.select("node", "n", F.explode("bands").alias("band"))

    def could_link(self, a: str, b: str):
        return (F.col(a) * 100 >= F.col(b) * self.percent) & (F.col(b) * 100 >= F.col(a) * self.percent)

    def check(self, pairs: DataFrame) -> DataFrame:
        """Pairs (x, y) that survive the signatures, as ``measure`` gives them."""
        sig = self.nodes.select("node", "sig")
        signed_pairs = (
            pairs.join(sig.select(F.col("node").alias("x"), F.col("sig").alias("sx")), "x")
            .join(sig.select(F.col("node").alias("y"), F.col("sig").alias("sy")), "y")
            .select("x", "y", "sx", "sy")
        )
        return self.measure(staged(signed_pairs.mapInArrow(_prune(self.percent, self.miss), "x long, y long"), "survivors"))

    def measure(self, left: DataFrame) -> DataFrame:
        """Pairs (x, y) with the exact size of what they have in common, whether they link, and the shingles that only
        one of them has."""
        wanted = left.select(F.explode(F.array("x", "y")).alias("node")).distinct()
        null_id = F.coalesce("least", F.lit(-(1 << 63)))
        ids = staged(wanted.join(self.nodes.select("node", "least"), "node").select(null_id.alias("id")).distinct(), "wanted")
        whole = self.norm.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(small(ids), "id", "left_semi")
        texts = whole.select("norm").mapInArrow(_nodes_of_texts(self.width), "node long, text string").dropDuplicates(["node"])
        texts = staged(texts, "texts")
        full = (
            left.join(texts.select(F.col("node").alias("x"), F.col("text").alias("tx")), "x")
            .join(texts.select(F.col("node").alias("y"), F.col("text").alias("ty")), "y")
            .select("x", "y", "tx", "ty")
        )
        return staged(full.mapInArrow(_verify(self.width, self.percent), "x long, y long, common long, linked boolean, differ array<long>"), "verified")


def classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, miss: float = MISS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, node.

    Texts are lower-cased (A-Z) and cut into words at spaces and 0x09-0x0D; a text with fewer than ``width`` words has
    its whole sequence as its one shingle. Sets link when 100 * intersection >= percent * union. Null, empty and
    blank texts have no shingles and link with nothing. ``component_id`` is the smallest id that links reach; a row
    with a null id takes part but never lends its id. Columns other than the two are not read.
    """
    spark: SparkSession = docs.sparkSession
    links = _Links(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), width, percent, miss)
    # buckets with several nodes; the node that meets most others is a bucket's pivot: of copies it is the likeliest original
    sizes = staged(links.in_bands.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets")
    shared = staged(links.in_bands.join(sizes, "band").select("band", "node", "n", "m"), "shared")
    weights = staged(shared.groupBy("node").agg(F.sum("m").alias("weight")), "weights")
    members = staged(shared.join(weights, "node").select("band", "node", "n", "weight", F.col("node").alias("comp")), "members")
    best = F.max(F.struct("weight", "node", "n")).alias("p")
    pivots = staged(members.groupBy("band").agg(best).select("band", F.col("p.node").alias("x"), F.col("p.n").alias("nx")), "pivots")
    met = staged(members.join(pivots, "band").where("node <> x").select("band", "node", "n", "x", "nx"), "met")
    first = links.check(met.where(links.could_link("n", "nx")).select("x", F.col("node").alias("y")).distinct())
    edges = first.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))

    # a pivot has met its whole bucket and leaves it; buckets within one component are done
    met = met.join(components(spark, edges), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    met = staged(met.join(first.select("x", F.col("y").alias("node"), "common"), ["x", "node"], "left"), "measured")
    mixed = met.groupBy("band").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("m")).where("c1 <> c2")
    mixed = staged(mixed.select("band", (F.col("m") <= FEW).alias("few")), "mixed")
    left = staged(met.join(mixed, "band").select("band", "node", "n", "x", "nx", "comp", "common", "few"), "left")
    few = left.where("few")
    other = few.select("band", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"))
    pairs = few.join(other, "band").where("node < y and comp <> cy").where(links.could_link("n", "ny")).select(F.col("node").alias("x"), "y")

    # in a larger bucket every node is measured against the pivot, also those that cannot link with it
    many = staged(left.where("not few").select(F.col("x").alias("pivot"), "nx", "node", "n", "comp", "common").distinct(), "around")
    more = links.measure(staged(many.where("common is null").select(F.col("pivot").alias("x"), F.col("node").alias("y")), "unmeasured"))
    edges = staged(edges.union(more.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
    exact = first.union(more).select(F.col("x").alias("pivot"), F.col("y").alias("node"), F.col("common").alias("exact"), "differ")
    # two nodes share ky + common - nx shingles, and one more for each difference to the pivot that they have in common;
    # so nodes of different components need some such differences to link, at least as many as with the node that needs fewest
    whole = F.lit(100 + percent)
    around = many.drop("common").join(exact, ["pivot", "node"]).withColumn("owes", F.col("n") * percent - F.col("exact") * whole)
    around = staged(around, "differences")
    fewest = staged(around.groupBy("pivot").agg(F.min("owes").alias("fewest")), "fewest")
    differing = around.select("pivot", "nx", "node", "n", "comp", "owes", F.explode("differ").alias("shingle"))
    often = differing.groupBy("pivot", "shingle").agg(F.count(F.lit(1)).alias("often"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    often = staged(often.where("c1 <> c2").select("pivot", "shingle", "often"), "often")
    # one of the common differences is among the rarer ones of each node (in one order for both)
    rank = F.row_number().over(W.partitionBy("pivot", "node").orderBy(F.col("often").desc(), "shingle"))  # within one text
    ranked = differing.join(often, ["pivot", "shingle"]).withColumn("behind", rank).join(fewest, "pivot")
    ranked = staged(ranked.where(F.col("behind") >= F.ceil((F.col("owes") + F.col("fewest") + F.col("nx") * whole) / whole)).drop("fewest", "often"), "ranked")
    sides = ranked.select("pivot", "shingle", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"), F.col("owes").alias("oy"), F.col("behind").alias("by"))
    needed = F.ceil((F.col("owes") + F.col("oy") + F.col("nx") * whole) / whole)
    by_shingle = ranked.join(sides, ["pivot", "shingle"]).where("node < y and comp <> cy").where(links.could_link("n", "ny"))
    by_shingle = by_shingle.where((F.col("behind") >= needed) & (F.col("by") >= needed))
    second = links.check(pairs.union(by_shingle.select(F.col("node").alias("x"), "y")).distinct())
    edges = edges.union(second.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b")))

    comps = components(spark, edges)
    named = links.nodes.select("node", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    heads = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    # only nodes whose component has another id than their own rows need an entry
    names = named.join(heads, "comp").select("node", "component_id")
    copies = links.rows.groupBy("node").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("node")
    names = staged(names.join(copies.union(comps.select("node")).distinct(), "node", "left_semi"), "names")
    own = F.coalesce("component_id", "doc_id")
    return links.rows.select("doc_id", "n_shingles", "node").join(small(names), "node", "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.col("component_id").isNull()).alias("kept"), "node"
    )


def _with_node(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column("norm")):
                nodes = node_ids(*sets_of(buf, offs, width))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), batch.column("id").slice(i, j - i), pa.array(signed(nodes), pa.int64())], ["row", "id", "node"])

    return run


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the one with the smallest id; all columns stay as they are.

    A row goes when its id and its own text's shingles are those of a row that is not kept, so another text under the
    same id stays. Rows that repeat the kept id inside one group are all kept, for the id cannot tell them apart; in a group
    without any id all rows stay.
    """
    found = classes(docs, doc_id, text, width, percent)
    gone = staged(found.where("not kept").select(F.col("doc_id").alias("id"), "node").distinct(), "gone")
    # the row travels in one struct, so no name of the table can clash with one of these
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.col(f"`{doc_id}`").cast("long").alias("id"), ascii_lower(F.col(f"`{text}`")).alias("norm"))
    ids = small(gone.select(F.col("id").alias("gone_id")).distinct())
    named = F.col("id").eqNullSafe(F.col("gone_id"))
    clear = rows.join(ids, named, "left_anti").select("row")
    kind = rows.select("row", "id").schema.add("node", "long")
    doubted = rows.join(ids, named, "left_semi").mapInArrow(_with_node(width), kind)
    out = small(gone.select(F.col("id").alias("gone_id"), F.col("node").alias("gone_node")))
    stay = doubted.join(out, named & (F.col("node") == F.col("gone_node")), "left_anti").select("row")
    return clear.unionByName(stay).select("row.*")
