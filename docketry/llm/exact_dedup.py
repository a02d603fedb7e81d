"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. A narrow table holds a 64-bit fingerprint and the SHA-256 of every normalised text. Its rows form senders of at
   most ``SENDER_ROWS`` rows.
2. Every sender sends each owner (a range of fingerprints) its sorted distinct fingerprints, as Golomb-coded gaps.
3. Every owner answers each sender with a bitmap: which of its fingerprints another sender has too.
4. Senders mark their suspects: rows whose bit is set, or that share a fingerprint inside the sender.
5. Only suspects' texts are grouped byte by byte, after equal texts of a map task have been combined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import ascii_lower, signed, small
from docketry.session import staged

SENDER_BITS = 20
#: Fingerprints an owner answers for, about; the number of owners follows the number of rows.
OWNER_ROWS = 1 << 18


def golomb_encode(values: np.ndarray) -> bytes:
    """Code sorted distinct uint64 values: gaps by Golomb's code with a power of two as divisor.

    Layout: count, divisor bits and first value (8 bytes each), the unary quotients of all gaps, then the remainders.
    """
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values)
    mean = max(1, int(values[-1] - values[0]) // max(1, n - 1))
    k = max(0, (mean * 7 // 10).bit_length() - 1)
    head = np.array([n, k, values[0]], np.uint64).tobytes()
    if n == 1:
        return head
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return head + np.array([len(unary)], np.uint64).tobytes() + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n, k = (int(x) for x in np.frombuffer(data, np.uint64, 2))
    first = np.frombuffer(data, np.uint64, 3)[2:]
    if n == 1:
        return first.copy()
    bits = int(np.frombuffer(data, np.uint64, 1, 24)[0])
    raw = np.frombuffer(data, np.uint8, offset=32)
    stop = (bits + 7) // 8
    ends = np.flatnonzero(np.unpackbits(raw[:stop], count=bits) == 0)
    q = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(raw[stop:], count=(n - 1) * k).reshape(n - 1, k).astype(np.uint64)
    gaps = (q.astype(np.uint64) << np.uint64(k)) + (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return first + np.concatenate([np.zeros(1, np.uint64), np.cumsum(gaps, dtype=np.uint64)])


def _unsigned(h: pd.Series) -> np.ndarray:
    return h.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)  # order of the signed values


def _owners(values: np.ndarray, owners: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _send(owners: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(_unsigned(pdf.h))
        to = _owners(own, owners)
        cut = np.searchsorted(to, np.arange(owners + 1))
        rows = [(int(pdf.sender.iloc[0]), o, golomb_encode(own[cut[o] : cut[o + 1]])) for o in np.unique(to)]
        return pd.DataFrame(rows, columns=["sender", "owner", "codes"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    lists = [golomb_decode(c) for c in pdf.codes]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = values[counts > 1]
    bitmaps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
    return pd.DataFrame({"sender": pdf.sender, "owner": pdf.owner, "bitmap": bitmaps})


def _suspects(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Fingerprints of a sender that occur twice anywhere."""
    own, counts = np.unique(_unsigned(rows.h), return_counts=True)
    twice = counts > 1
    if len(answers):
        answers = answers.sort_values("owner")
        owners = int(rows.owners.iloc[0])
        to = _owners(own, owners)
        for o, bitmap in zip(answers.owner, answers.bitmap, strict=True):
            a, b = np.searchsorted(to, [o, o + 1])
            twice[a:b] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=b - a).astype(bool)
    return pd.DataFrame({"h": signed(own[twice] ^ np.uint64(1 << 63))})


def suspect_fingerprints(prints: DataFrame, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """Distinct fingerprints ``h`` that several rows of ``prints`` (sender, h) have."""
    n = prints.count()
    owners = max(1, -(-n // owner_rows))
    sent = prints.groupBy("sender").applyInPandas(_send(owners), "sender long, owner long, codes binary")
    answers = sent.groupBy("owner").applyInPandas(_answer, "sender long, owner long, bitmap binary")
    rows = prints.select("sender", "h", F.lit(owners).alias("owners"))
    return rows.groupBy("sender").cogroup(answers.groupBy("sender")).applyInPandas(_suspects, "h long").distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sender_bits: int = SENDER_BITS, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_sha256, keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id of a
    class stays (a null id loses against any other; of rows with one id, exactly one stays). Other columns of
    ``docs``, whatever their names, are not read.
    """
    norm = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), ascii_lower(F.col(f"`{text}`")).alias("norm"))
    prints = staged(
        norm.select("doc_id", F.xxhash64("norm").alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")).withColumn("row", F.monotonically_increasing_id()),
        "fingerprints",
    )
    twice = staged(suspect_fingerprints(prints.select(F.shiftright("row", sender_bits).alias("sender"), "h"), owner_rows), "suspects")
    twice = small(twice)
    # byte verification: equal normalised texts, not equal fingerprints, make a class
    proven = (
        norm.withColumn("h", F.xxhash64("norm"))
        .join(twice, "h", "left_semi")
        .groupBy("norm")
        .agg(F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "group_size")
    )
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("real"), "doc_id", "row")).alias("last")
    winners = prints.join(twice, "h", "left_semi").groupBy("text_sha256").agg(last)
    groups = small(staged(proven.join(winners, "text_sha256").select("text_sha256", "group_size", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row")), "groups"))
    one = F.col("group_size").isNull()
    return prints.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (one | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; of rows equal in id and text, one stays."""
    dropped = classes(docs, doc_id, text)
    lost = dropped.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    lost = small(staged(lost, "copies"))
    # the row travels in one struct, so no name of the table can clash with one of these
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sha = F.sha2(ascii_lower(F.col(f"`{text}`")).cast("binary"), 256).alias("sha")
    rows = docs.select(whole, F.col(f"`{doc_id}`").alias("id"), sha)
    lost = lost.select(F.col("doc_id").alias("lost_id"), F.col("text_sha256").alias("lost_sha"), "kept")
    found = rows.join(lost, F.col("sha").eqNullSafe(F.col("lost_sha")) & F.col("id").eqNullSafe(F.col("lost_id")), "left")
    alone = found.where("kept is null").select("row")
    repeated = found.where("kept").dropDuplicates(["id", "sha"]).select("row")
    return alone.unionByName(repeated).select("row.*")
