"""Quality by importance resampling.

Texts are bags of hashed n-grams: tokens (runs of letters or of signs, lower-cased) and pairs of neighbours. A target
model is counted over labelled good documents, a raw model over all documents. A document's importance weight is the ratio of
its probabilities under the two; adding Gumbel noise to the logarithms and taking the k largest draws k documents
without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import KINDS, TO_LOWER, U64, blocks, class_bounds, mix, small, word_hashes
from docketry.session import staged

BUCKETS = 1 << 14
#: Labelled rows the target model and the choice of k are fitted on, at most (those with the smallest hashes).
LABELLED = 20_000


def ngrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram. A token that follows itself counts as one common pair, "the same again"."""
    low = TO_LOWER[buf]
    s, e, row = class_bounds(low, offs, KINDS)
    h = word_hashes(low, s, e)
    pair = row[1:] == row[:-1]
    two = np.where(h[1:] == h[:-1], U64(1), mix(h[:-1] * U64(3) + h[1:]))[pair]
    return (np.concatenate([h, two]) >> U64(50)).astype(np.int64), np.concatenate([row, row[1:][pair]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        good = np.array([bool(x) for x in batch.column(1).to_pylist()], bool)
        for i, _, buf, offs in blocks(batch.column(0)):
            bucket, row = ngrams(buf, offs)
            counts[0] += np.bincount(bucket, minlength=BUCKETS)
            counts[1] += np.bincount(bucket[good[i + row]], minlength=BUCKETS)
    at = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "raw", "target"])


def _score(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1)):
                bucket, row = ngrams(buf, offs)
                weight = np.bincount(row, ratio[bucket], minlength=j - i)
                n = np.bincount(row, minlength=j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(weight, pa.float64()), pa.array(n, pa.int64())], ["row", "log_weight", "n_ngrams"])

    return run


def labelled_sample(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids with a boolean ``good``; an id with several labels is good if all of them are."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


class Resampler:
    """The fitted ratio of the target and the raw model, and the sampling key from which on documents are drawn."""

    def __init__(self, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LABELLED, seed: int = 0) -> None:
        self.seed = seed
        sample = staged(labelled_sample(labels, limit), "labelled")
        pairs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        known = pairs.join(small(sample), "doc_id", "left")
        counts = known.select("text", "good").mapInArrow(_count, "bucket long, raw long, target long")
        table = np.ones((2, BUCKETS))
        for b, raw, target in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # BUCKETS rows at most
            table[:, b] += raw, target
        raw, target = table / table.sum(axis=1)[:, None]
        # without a labelled good document both models are the raw one
        self.ratio = np.log(target / raw) if sample.where("good").limit(1).count() else np.zeros(BUCKETS)
        self.scores = staged(self.scored(known.select(F.struct("doc_id", "good").alias("row"), "text")).select("row.*", "log_weight", "n_ngrams", "key"), "weights")
        self.cut = self._cut()

    def scored(self, rows: DataFrame) -> DataFrame:
        """(row, log_weight, n_ngrams, key) of ``rows`` (row, text), where ``row`` is a struct with a field ``doc_id``."""
        kind = rows.schema["row"].dataType.simpleString()
        out = rows.mapInArrow(_score(self.ratio), f"row {kind}, log_weight double, n_ngrams long")
        u = (F.shiftrightunsigned(F.xxhash64(F.col("row.doc_id"), F.lit(self.seed)), 12).cast("double") + 0.5) / float(1 << 52)
        return out.withColumn("key", F.col("log_weight") - F.log(-F.log(u)))

    def _cut(self) -> float:
        """The k-th largest sampling key; k is the number of documents whose weight passes the best split of the labels."""
        # the bounded sample: one row for each labelled id, however often the id is in the table
        fit = self.scores.where("good is not null").groupBy("doc_id", "good").agg(F.max("log_weight").alias("log_weight")).select("log_weight", "good").collect()
        goods = sum(g for _, g in fit)
        if not goods or goods == len(fit):
            return -np.inf
        fit.sort()
        w, good = np.array([x[0] for x in fit]), np.array([x[1] for x in fit])
        # rejecting the i smallest: wrong are good ones among them and bad ones after them
        wrong = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([[0], np.cumsum(~good)])[-1] - np.concatenate([[0], np.cumsum(~good)])
        wrong[1:-1][w[1:] == w[:-1]] = len(fit) + 1
        best = np.flatnonzero(wrong == wrong.min())
        i = int(best[0])
        split = -np.inf if i == 0 else (np.inf if i == len(fit) else (w[i - 1] + w[i]) / 2)
        k = self.scores.where(F.col("log_weight") >= F.lit(float(split))).count()
        return kth_largest(self.scores.select("key"), k)


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest of a double column ``key``, by counts in ever smaller ranges; rows stay where they are."""
    if k <= 0:
        return np.inf
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k >= n:
        return -np.inf
    above = 0
    while True:
        inside = keys.where((F.col("key") >= F.lit(lo)) & (F.col("key") <= F.lit(hi)))
        if not lo < hi:
            return lo
        place = F.least(F.floor((F.col("key") - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1))
        rows = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                if len(rows) == 1 or r["n"] == 1:
                    return r["lo"] if r["n"] == 1 or r["lo"] == r["hi"] else _among(inside, k - above)
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]


def _among(keys: DataFrame, k: int) -> float:
    """Values too close to be cut into ranges: count them one by one (a few neighbouring doubles)."""
    for value, n in sorted(keys.groupBy("key").count().collect(), reverse=True):
        k -= n
        if k <= 0:
            return value
    return -np.inf


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LABELLED, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, log_weight, n_ngrams, key and whether it is ``selected``.

    ``labels`` has doc_id and quality (1: target). ``limit`` bounds the labelled rows that are used; the raw model, the
    weights and the draw cover all documents. Null and empty texts have no n-grams and weight 0. Rows whose key equals
    the k-th are all drawn. Without labels of both kinds every row is selected. Other columns are not read.
    """
    fitted = Resampler(docs, labels, doc_id, text, limit, seed)
    return fitted.scores.select("doc_id", "log_weight", "n_ngrams", "key", (F.col("key") >= F.lit(float(fitted.cut))).alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LABELLED, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns as they are."""
    fitted = Resampler(docs, labels, doc_id, text, limit, seed)
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(F.struct(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), *inner).alias("row"), F.col(f"`{text}`").alias("text"))
    return fitted.scored(rows).where(F.col("key") >= F.lit(float(fitted.cut))).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
