"""Quality classifier by Bradley-Terry pairwise ranking."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from toolcorpus.llm.common import hash_unit, materialize
from toolcorpus.llm.language_id import held_out

# Bounds of the training sample: labelled texts per class, and preference pairs.
TEXTS_PER_CLASS, PAIRS = 2000, 30_000
KNOTS, STEPS, RATE, DECAY = 8, 300, 0.05, 1e-3
# Variance of all n-gram features together, as a multiple of that of the described features.
GRAM_SHARE = 1.0
# Buckets of each kind of hashed n-gram, bytes taken at once, texts scored at once.
GRAM_BITS, PIECE, BLOCK = 10, 1 << 20, 256
MARKS = b"!*%$&#|@<>{}[]\\/=+_~^;:?\"'()-.,"


def describe(text: str | None) -> list[float]:
    """Numbers that describe a whole text: sizes, shares of kinds of characters, repetition."""
    raw = (text or "").encode()
    words = raw.split()
    n, n_words = max(1, len(raw)), max(1, len(words))
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    top = max(counts.values(), default=0)
    packed = len(zlib.compress(raw, 1)) / n
    marked = sum(1 for w in counts if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?") if words else 0
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    return [math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)), upper / max(1, upper + lower),
            int(byte[48:58].sum()) / n, int(byte[128:].sum()) / n, packed, min(packed, 1.0) * math.log1p(n),
            len(counts) / n_words, len(counts) / n_words * math.log1p(n_words), top / n_words, 1 - len(set(lines)) / max(1, len(lines)),
            float(size.mean()), float(size.std()), math.log1p(float(size.max())), len(lines) / n_words,
            marked / max(1, len(counts)), *(int(byte[m]) / n_words for m in MARKS)]


def grams(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed 3-grams of bytes, and of hashed words and word pairs, of a whole lower-cased text."""
    raw = (text or "").lower().encode()
    buckets = 1 << GRAM_BITS
    bucket = lambda code: (code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
    letters, words = np.zeros(buckets), np.zeros(buckets)
    for at in range(0, len(raw) - 2, PIECE):
        b = np.frombuffer(raw[at:at + PIECE + 2], np.uint8).astype(np.uint32)
        letters += np.bincount(bucket(b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]), minlength=buckets)
    found = raw.split()
    if found:
        codes = {w: zlib.crc32(w) for w in set(found)}
        code = np.fromiter(map(codes.__getitem__, found), np.uint32, len(found))
        words += np.bincount(bucket(code), minlength=buckets)
        words += np.bincount(bucket(code[:-1] * np.uint32(40503) + code[1:]), minlength=buckets)
    return np.sqrt(np.concatenate([letters / max(1.0, letters.sum()), words / max(1.0, words.sum())]))


def features(text: str | None) -> np.ndarray:
    return np.concatenate([describe(text), grams(text)])


@dataclass
class Ranking:
    """Hinge knots per feature, weights of the hinges, and the score at the threshold quantile."""

    knots: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (hinges(x, self.knots) - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that the text is preferred to one at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -500, 500)))


def hinges(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Each feature, and what the first ones, those with knots, have above each of theirs."""
    bent = x[:, :knots.shape[1]]
    return np.concatenate([x, *(np.maximum(bent - k, 0) for k in knots)], axis=1)


def pair_gradient(h: np.ndarray, w: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Gradient of the mean of ``log(1 + exp(-(h[up] - h[down]) w))`` and of the decay: the pairs are summed by row first."""
    s = (h @ w.astype(h.dtype)).astype(np.float64)
    pull = -1 / (1 + np.exp(np.clip(s[up] - s[down], -500, 500))) / len(up)
    rows = np.bincount(up, pull, len(h)) - np.bincount(down, pull, len(h))
    return h.T @ rows.astype(h.dtype) + DECAY * w


def train(good: np.ndarray, bad: np.ndarray, good_share: float, n_grams: int = 0, seed: int = 13) -> Ranking:
    """Logistic loss on feature differences of pairs (good, bad); threshold at the quantile that leaves ``good_share`` above.

    The last ``n_grams`` features have no knots and share one scale, by which
    all of them together vary ``GRAM_SHARE`` times as much as the others before their knots.
    """
    x = np.concatenate([good, bad])
    plain = x.shape[1] - n_grams
    knots = np.quantile(x[:, :plain], np.linspace(0.02, 0.98, KNOTS), axis=0).astype(x.dtype)
    h = hinges(x, knots)
    del x
    mean, scale = h.mean(0), h.std(0)
    if n_grams:
        scale[plain:plain + n_grams] = math.sqrt(float((scale[plain:plain + n_grams] ** 2).sum()) / (plain * GRAM_SHARE))
    scale[scale < 1e-9] = 1.0
    h -= mean
    h /= scale
    rng = np.random.default_rng(seed)
    up, down = rng.integers(len(good), size=PAIRS), len(good) + rng.integers(len(bad), size=PAIRS)
    w, m, v = np.zeros(h.shape[1]), np.zeros(h.shape[1]), np.zeros(h.shape[1])
    for step in range(1, STEPS + 1):
        g = pair_gradient(h, w, up, down)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    s = h @ w
    mass = np.concatenate([np.full(len(good), good_share / len(good)), np.full(len(bad), (1 - good_share) / len(bad))])
    order = np.argsort(s, kind="stable")
    at = int(np.searchsorted(np.cumsum(mass[order]), 1 - good_share))
    at = min(max(at, 0), len(s) - 2)
    return Ranking(knots, mean, scale, w, float((s[order[at]] + s[order[at + 1]]) / 2))


def strengths_of(model: Ranking, texts: pd.Series) -> np.ndarray:
    """Strengths of texts, in blocks so that few feature vectors are held at once."""
    texts = list(texts)
    blocks = [model.strength(np.array([features(t) for t in texts[i:i + BLOCK]])) for i in range(0, len(texts), BLOCK)]
    return np.concatenate(blocks) if blocks else np.zeros(0)


def described(text: Column) -> Column:
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).astype(np.float32).tobytes() for t in texts], dtype="object")

    return run(text)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_class: int = TEXTS_PER_CLASS) -> Ranking | None:
    """Fit to about ``per_class`` labelled texts of each class, drawn by a hash of the identifier; None without both classes.

    Only drawn labels, a bounded set, are joined to the texts, and only
    described texts come to the driver.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / counts[1]))).otherwise(F.lit(min(1.0, per_class / counts[0])))
    drawn = known.where(hash_unit("quality", F.col("id")) < share).limit(4 * per_class)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    drawn = texts.join(F.broadcast(drawn), "id")
    # Texts are described where they are read. Repeated rows or labels make more rows of one draw, so each class is bounded once more.
    drawn = drawn.select("y", described(F.col("t")).alias("x"), hash_unit("quality-row", F.col("id"), F.md5(F.col("t"))).alias("at"))
    sample = {y: sorted(bytes(r["x"]) for r in drawn.where(F.col("y") == y).orderBy("at", "x").limit(2 * per_class).collect())
              for y in (0, 1)}
    if not sample[0] or not sample[1]:
        return None
    good, bad = (np.array([np.frombuffer(x, np.float32) for x in sample.pop(y)]) for y in (1, 0))
    return train(good, bad, counts[1] / (counts[0] + counts[1]), 2 << GRAM_BITS)


def with_threshold(model: Ranking, strengths: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Ranking:
    """``model`` with its threshold at the quantile of ``strengths (doc_id, s)`` of all labelled texts that leaves the share of label 1 above it."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(label_col).alias("y"))
    labelled = strengths.join(known, "doc_id").select("y", "s")
    share = labelled.agg(F.avg("y").alias("share")).first()["share"]
    if share is None:
        return model
    at = labelled.agg(F.percentile_approx("s", F.lit(1.0 - float(share)), F.lit(100_000)).alias("t")).first()["t"]
    return replace(model, threshold=float(at))


def rank_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every whole text.

    Learns from labels 0 and 1 of rows whose crc32 of the identifier modulo 3
    is not 1 (other labels, null identifiers and identifiers without a text
    are passed over; several labels of one text all count). The score is the
    Bradley-Terry probability that the text beats one at the quantile of the
    scores of all labelled learning texts that leaves the share of label 1
    above it (``with_threshold``; the fit alone is on a bounded sample); ``predicted``
    is 1 from a score of 0.5. Texts are described by sizes and shares (``describe``) and by
    hashed n-grams of bytes and words (``grams``), very long ones whole. Null and empty texts are described as texts of
    no characters. Without labels of both classes every score is 0.5. Repeated
    rows get a row each; an empty table gives none; other columns are ignored.
    """
    kept = labels.where(~held_out(F.col(id_col), 3, 1))
    model = fit(docs, kept, id_col, text_col, label_col)
    known = [F.col(id_col).alias("doc_id"), held_out(F.col(id_col), 3, 1).alias("held_out")]
    if model is None:
        out = docs.select(*known, F.lit(0.5).alias("score"))
    else:
        @F.pandas_udf("double")
        def strength(texts: pd.Series) -> pd.Series:
            return pd.Series(strengths_of(model, texts))

        # Every text is described once; the threshold and the scores are taken from the narrow table of strengths.
        strengths = materialize(docs.select(*known, strength(F.col(text_col)).alias("s")), "strengths")
        at = with_threshold(model, strengths, kept, id_col, label_col).threshold
        out = strengths.select("doc_id", "held_out", (1 / (1 + F.exp(F.least(F.lit(at) - F.col("s"), F.lit(500.0))))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
