"""Rendezvous sharding over weighted shards, and gapless slots in each shard. Built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hash blocks of a shard in which slots are numbered; only one count for each block meets in a task.
BLOCKS = 1024


def shard_of(key: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard whose score for the key is highest; ``weights[i]`` is the share of shard ``i`` (0 takes nothing).

    The score of a shard is ``-weight / ln(u)``, where u in (0, 1) depends on the key and on the shard's number alone.
    A further shard therefore wins some keys and moves no other key; a changed weight moves keys only to or from its
    shard. Equal scores go to the larger number. A null key part counts as a value of its own.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    parts = [x for k in key for x in (k, k.isNull())]
    scores = []
    for i, w in enumerate(weights):
        if w > 0:
            # 52 bits of the hash as a number strictly between 0 and 1
            u = (F.shiftrightunsigned(F.xxhash64(F.lit(i), *parts), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
            scores.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(i).alias("shard")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return best["shard"]


def assign(df: DataFrame, key: Sequence[str], weights: Sequence[float], into: str = "shard") -> DataFrame:
    """``df`` with the shard number in ``into`` (a map-only plan; a column of that name is replaced)."""
    return df.withColumn(into, shard_of([F.col(f"`{k}`") for k in key], weights))


def slots(df: DataFrame, shard: str, order: Sequence[str]) -> DataFrame:
    """The columns ``shard`` and ``order`` with ``slot``: a gapless number from 0 inside each shard.

    Equal rows are counted before the shuffle and expanded at the end, so a row that repeats very often is one row on
    the way. Distinct rows are numbered inside hash blocks; the blocks' counts give where each block begins.
    """
    cols = [F.col(f"`{c}`") for c in order]
    rows = df.groupBy(F.col(f"`{shard}`"), *cols).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*cols), F.lit(BLOCKS)))
    sums = rows.groupBy(shard, "_block").agg(F.sum("_n").alias("_rows"))
    ahead = W.partitionBy(shard).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(shard, "_block", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_start"))
    inside = W.partitionBy(shard, "_block").orderBy(*cols).rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    first = F.col("_start") + F.col("_before")
    return (
        numbered.join(starts, [shard, "_block"])
        .withColumn("slot", F.explode(F.sequence(first, first + F.col("_n") - 1)))
        .select(shard, *cols, "slot")
    )
