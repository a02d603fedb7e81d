"""Toxic spans by a linear-chain conditional random field over the words of a text.

Document labels become token labels: in a toxic training document, words that training documents of the toxic class hold far more
often than the others are toxic tokens; all other tokens are clean. The field has two states; a token's features are its
word, the word before and the word after (those known from training), and the transitions between states. Forward and backward sums give
every token's marginal; the largest logit and the expected number of toxic tokens of a text are turned into its score by
a small logistic regression, and tokens with marginal 1/2 or more are the offending spans.

Training reads a bounded sample of labelled rows (``TRAIN`` of each class), of each the first ``TRAIN_CHARS`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import KINDS, TO_LOWER, U64, blocks, class_bounds, mix, small, word_hashes
from docketry.session import staged

TRAIN = 1500
#: Characters of a training text that are read, so that the sample is bounded in bytes too; scores read whole texts.
TRAIN_CHARS = 100_000
#: Training texts that hold a word, for it to be known at all, and tokens beside it, for it to count as a neighbour.
KNOWN = 3
COMMON = 50
#: Places and excess that make a word a toxic token.
SUPPORT, SHARE = 4, 20
CHUNK = 256
LETTERS = np.where(KINDS == 1, 1, 0).astype(np.uint8)


@dataclass
class Field:
    """Weights by feature (for the toxic state against the clean one), transitions, and the score's regression.

    ``words`` holds the sorted hashes of the known words; feature 0 of each of the three places is any other word.
    """

    words: np.ndarray
    emit: np.ndarray
    start: float
    stay: np.ndarray  # log potentials [from, to]
    score: np.ndarray  # bias, largest logit, log(1 + expected tokens)


def features(h: np.ndarray, row: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Three features of every token: its word, the one before it and the one after it in its row."""
    size = len(words) + 1
    at = np.searchsorted(words, h)
    known = np.zeros(len(h), np.int64)
    if len(words):
        known = np.where(words[np.minimum(at, len(words) - 1)] == h, at + 1, 0)
    out = np.zeros((len(h), 3), np.int64)
    out[:, 0] = known
    if len(h):
        same = row[1:] == row[:-1]
        out[1:, 1][same], out[:-1, 2][same] = known[:-1][same], known[1:][same]
    return out + np.array([0, size, 2 * size])


def marginals(emit: np.ndarray, mask: np.ndarray, start: float, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the toxic state of every token, for rows of emissions padded at the end; and the transitions' expectations.

    Works on log odds: one number a token and direction.
    """
    n, t = emit.shape
    ahead, back = np.zeros((n, t)), np.zeros((n, t))
    (a, b), (c, d) = stay
    for i in range(t):
        ahead[:, i] = emit[:, i] + (start if i == 0 else np.logaddexp(b, ahead[:, i - 1] + d) - np.logaddexp(a, ahead[:, i - 1] + c))
    for i in range(t - 2, -1, -1):
        odds = np.where(mask[:, i + 1], emit[:, i + 1] + back[:, i + 1], -np.inf)
        step = np.logaddexp(c, odds + d) - np.logaddexp(a, odds + b)
        back[:, i] = np.where(mask[:, i + 1], step, 0)
    logit = ahead + back
    expect = np.zeros((2, 2))
    if t > 1:
        pair = mask[:, 1:]
        left, right = ahead[:, :-1][pair], (emit + back)[:, 1:][pair]
        w = np.stack([np.full(len(left), a), right + b, left + c, left + right + d])
        w = np.exp(w - w.max(axis=0))
        expect = (w / w.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return logit, expect


def fit_field(rows: list[tuple[np.ndarray, np.ndarray]], words: np.ndarray, rounds: int = 20) -> Field:
    """Train on (features, token labels) of texts; long texts are read in chunks of CHUNK tokens."""
    parts = [(f[i : i + CHUNK], y[i : i + CHUNK]) for f, y in rows for i in range(0, len(f), CHUNK)]
    n, t = len(parts), max((len(f) for f, _ in parts), default=0)
    feats, gold, mask = np.zeros((n, t, 3), np.int32), np.zeros((n, t), np.int8), np.zeros((n, t), bool)
    for i, (f, y) in enumerate(parts):
        feats[i, : len(f)], gold[i, : len(f)], mask[i, : len(f)] = f, y, True
    emit, bias, stay = np.zeros(3 * len(words) + 3), np.array([-4.0]), np.zeros((2, 2))
    grads = [np.zeros_like(x) for x in (emit, bias, stay)]
    truth = np.zeros((2, 2))
    if t > 1:
        np.add.at(truth, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    word, near = feats[mask][:, 0], feats[mask][:, 1:].reshape(-1)
    # neighbours count only where they are common; rare ones would be learned by heart
    common = np.bincount(near, minlength=len(emit)) >= COMMON
    for _ in range(rounds if n else 0):
        e = np.where(mask, emit[feats].sum(axis=2) + bias[0], 0)
        logit, expect = marginals(e, mask, 0.0, stay)
        miss = (gold - 1 / (1 + np.exp(-np.clip(logit, -30, 30))))[mask]
        ge = np.bincount(word, miss, minlength=len(emit)) + common * np.bincount(near, np.repeat(miss, 2), minlength=len(emit)) - 0.01 * emit
        for x, g, total in zip((emit, bias, stay), (ge, miss.sum(keepdims=True), truth - expect), grads, strict=True):
            total += g * g
            x += 0.7 * g / (np.sqrt(total) + 1e-6)
    return Field(words, emit + bias[0] / 3, 0.0, stay, np.zeros(3))


def _carry(maps: np.ndarray, width: int = 64) -> np.ndarray:
    """States v[t] = maps[:, t] v[t-1], up to scale, of a chain of 2 x 2 maps (maps[0..3] are its rows); v[-1] = (1, 1).

    Runs of ``width`` maps are multiplied side by side, the chain of their products is carried in the same way, and the
    runs are then walked side by side from the states where they begin.
    """
    n = maps.shape[1]
    if n <= width:
        out, x, y = np.empty((2, n)), 1.0, 1.0
        for t in range(n):
            a, b, c, d = maps[:, t]
            x, y = a * x + b * y, c * x + d * y
            x, y = x / (x + y), y / (x + y)
            out[:, t] = x, y
        return out
    m = -(-n // width)
    full = np.zeros((4, m * width))
    full[0], full[3] = 1, 1
    full[:, :n] = maps
    full = np.ascontiguousarray(full.reshape(4, m, width).transpose(0, 2, 1))
    p, q, r, s = full[:, 0]
    for t in range(1, width):
        a, b, c, d = full[:, t]
        p, q, r, s = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        top = p + q + r + s
        p, q, r, s = p / top, q / top, r / top, s / top
    state = _carry(np.stack([p, q, r, s]), width)
    x, y = np.append(1.0, state[0, :-1]), np.append(1.0, state[1, :-1])
    out = np.empty((2, width, m))
    for t in range(width):
        a, b, c, d = full[:, t]
        x, y = a * x + b * y, c * x + d * y
        top = x + y
        x, y = x / top, y / top
        out[0, t], out[1, t] = x, y
    return out.transpose(0, 2, 1).reshape(2, -1)[:, :n]


def token_logits(field: Field, feats: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Log odds of the toxic state of every token of the rows limits[i]..limits[i+1]."""
    n = len(feats)
    if not n:
        return np.zeros(0)
    e = np.exp(np.clip(field.emit[feats].sum(axis=1), -30, 30))
    (a, b), (c, d) = np.exp(field.stay)
    full = limits[1:] > limits[:-1]
    one = np.ones(n)
    ahead = np.stack([a * one, c * one, b * e, d * e])
    start = limits[:-1][full]
    ahead[0, start] = ahead[1, start] = 1
    ahead[2, start] = ahead[3, start] = e[start] * np.exp(field.start)
    back = np.stack([a * one, b * np.append(e[1:], 1), c * one, d * np.append(e[1:], 1)])
    back[:, limits[1:][full] - 1] = 1
    x, y = _carry(ahead)
    u, v = _carry(back[:, ::-1])
    return np.log(np.maximum(y * v[::-1], 1e-300)) - np.log(np.maximum(x * u[::-1], 1e-300))


def summaries(logit: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """(1, largest logit, log(1 + expected toxic tokens)) of every row; a row without tokens has the lowest logit."""
    out = np.zeros((len(limits) - 1, 3))
    out[:, 0], out[:, 1] = 1, -15
    full = limits[1:] > limits[:-1]
    if full.any():
        clipped = np.clip(logit, -15, 15)
        out[full, 1] = np.maximum.reduceat(clipped, limits[:-1][full])
        out[full, 2] = np.log1p(np.add.reduceat(1 / (1 + np.exp(-clipped)), limits[:-1][full]))
    return out


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = TO_LOWER[buf]
    s, e, row = class_bounds(low, offs, LETTERS)
    return s, e, word_hashes(low, s, e), row, np.searchsorted(row, np.arange(len(offs)))


def toxic_words(h: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Words (sorted hashes) that mark toxic texts.

    A word counts once for each pair of neighbours it has, so copied texts and passages count once. It marks toxic texts if
    it has SUPPORT such places in them, and SHARE times as many, by the number of texts, as in clean ones.
    """
    before, after = np.roll(h, 1), np.roll(h, -1)
    place = mix(mix(h) + mix(before * U64(3)) + mix(after * U64(5)))
    _, first = np.unique(np.where(toxic[row], place | U64(1), place & ~U64(1)), return_index=True)
    words, at = np.unique(h[first], return_inverse=True)
    counts = np.zeros((2, len(words)))
    np.add.at(counts, (toxic[row[first]].astype(int), at), 1)
    n_toxic = toxic.sum()
    return words[(counts[1] >= SUPPORT) & (counts[1] * (len(toxic) - n_toxic) > SHARE * (counts[0] + 0.5) * n_toxic)]


def fit(texts: list[str | None], toxic: list[bool], share: float | None = None) -> Field:
    """Train on labelled texts; ``share`` is the part of all labels that is toxic, where it differs from the sample's."""
    if not texts or not any(toxic) or all(toxic):
        share = (sum(toxic) + 0.5) / (len(texts) + 1) if texts else 0.05
        return Field(np.zeros(0, np.uint64), np.zeros(3), -3.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0]))
    ((_, _, buf, offs),) = blocks(pa.array(texts, pa.string()), 1 << 62)
    _, _, h, row, limits = _tokens(buf, offs)
    own = [np.unique(h[limits[i] : limits[i + 1]]) for i in range(len(texts))]
    bad = toxic_words(h, row, np.array(toxic))
    vocabulary, times = np.unique(np.concatenate(own), return_counts=True)
    vocabulary = vocabulary[times >= KNOWN]
    feats = features(h, row, vocabulary)
    rows = []
    for i, t in enumerate(toxic):
        part = slice(limits[i], limits[i + 1])
        rows.append((feats[part], np.isin(h[part], bad) if t else np.zeros(limits[i + 1] - limits[i], bool)))
    field = fit_field(rows, vocabulary)
    x, y = summaries(token_logits(field, feats, limits), limits), np.array(toxic, float)
    scale = np.array([1.0, 5.0, 1.0])
    w = np.zeros(3)
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean())) if share is not None else np.ones(len(y))
    x /= scale
    for _ in range(60):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.05 * w
        w += np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.05 * np.eye(3), grad)
    field.score = w / scale
    return field


def _apply(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(1)):
                s, e, h, row, limits = _tokens(buf, offs)
                logit = token_logits(field, features(h, row, field.words), limits)
                score = 1 / (1 + np.exp(-np.clip(summaries(logit, limits) @ field.score, -30, 30)))
                hit = np.flatnonzero(logit >= 0)
                base = offs[np.searchsorted(limits, hit, "right") - 1]
                where = np.searchsorted(hit, limits)
                spans = pa.StructArray.from_arrays(
                    [pa.array(s[hit] - base, pa.int64()), pa.array(e[hit] - base, pa.int64()), pa.array(1 / (1 + np.exp(-logit[hit])), pa.float64())],
                    ["start", "end", "marginal"],
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(score), pa.ListArray.from_arrays(pa.array(where, pa.int32()), spans)], ["doc_id", "score", "spans"]
                )

    return run


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, limit: int) -> tuple[DataFrame, float]:
    """(doc_id, text, toxic) of at most ``limit`` labelled rows of each class, those with the smallest hashes of their id,
    and the share of toxic labels."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    share = rows.select(F.avg(F.col("toxic").cast("double"))).first()[0]
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = rows.where("toxic").orderBy(*order).limit(limit).union(rows.where("not toxic").orderBy(*order).limit(limit))
    sample = staged(sample, "toxic_labels")
    return docs.join(small(sample), "doc_id").select("doc_id", "text", "toxic"), share


def score(docs: DataFrame, labels: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text", limit: int = TRAIN) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1) and the offending ``spans`` (byte offsets and marginals).

    ``labels`` has doc_id and toxic; only rows that satisfy ``usable`` are learned from. Null and empty texts have no
    tokens and get the score of a text without any sign of toxicity. Without labels of both classes the score is the
    share of toxic labels. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    drawn, share = training_rows(rows, labels, F.lit(True) if usable is None else usable, limit)
    # a repeated id brings more texts; the bound holds for them too, in a fixed order
    drawn = drawn.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(2 * limit).withColumn("text", F.left("text", F.lit(TRAIN_CHARS))).collect()
    field = fit([r["text"] for r in drawn], [r["toxic"] for r in drawn], share)
    return rows.mapInArrow(_apply(field), "doc_id long, score double, spans array<struct<start:long,end:long,marginal:double>>")
