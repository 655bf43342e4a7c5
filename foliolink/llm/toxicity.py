"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None, bits: int = 20, stems: tuple[int, ...] = (4, 6)) -> np.ndarray:
    """Distinct buckets of the words, their first ``stems`` letters, word pairs and pairs with one word between.

    Words are runs of letters, lower-cased. The stems let inflected forms that no training
    text has share the weight of those that one has.
    """
    words = _TOKEN.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    pairs = (h[:-1] * _MIX) ^ (h[1:] >> np.uint64(1)) ^ np.uint64(1)
    skips = (h[:-2] * _MIX) ^ (h[2:] >> np.uint64(1)) ^ np.uint64(2)
    different = set(words)
    cut = [(n, stem) for n in stems for stem in {w[:n] for w in different if len(w) > n}]
    stemmed = np.fromiter((xxhash.xxh3_64_intdigest(stem, n) for n, stem in cut), np.uint64, len(cut))
    every = np.concatenate((h, pairs, skips, stemmed)) * _MIX >> np.uint64(64 - bits)
    return np.unique(every).astype(np.int64)


class FTRL:
    """Logistic regression by FTRL-proximal with a learning rate per coordinate."""

    def __init__(self, bits: int = 20, alpha: float = 1.0, beta: float = 1.0, l1: float = 16.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last coordinate is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, rate = self.z[at], (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(at.astype(np.int64), len(self.z) - 1)
        w = self.weights(at)
        g = weight * (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label)
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def train(
    rows: DataFrame, id_col: str, text_col: str, label_col: str, n_labelled: int, max_rows: int = 10_000, passes: int = 6, bits: int = 20, seed: int = 5, toxic_weight: float = 6.0, **options
) -> pd.DataFrame:
    """Weights ``(bucket, weight)`` other than zero, bias under bucket ``2**bits``.

    FTRL is sequential, so it sees a bounded sample: about ``max_rows`` of the ``n_labelled``
    labelled rows, drawn by a hash of the id, as lists of buckets. Rows with a null label are
    no examples. One task reads the sample in a seeded order, ``passes`` times; rows of label 1,
    the rare ones, count ``toxic_weight`` times. The defaults of these, of the stems and of the
    L1 penalty come from a comparison within the learnt folds.
    """
    part = min(1.0, max_rows / max(n_labelled, 1))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_000)) / 1e6

    @F.pandas_udf(T.BinaryType())
    def packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([features(t, bits).astype("<u4").tobytes() for t in texts])

    sample = rows.where(F.col(label_col).isNotNull() & (draw < part)).select(
        F.col(label_col).cast("int").alias("label"), packed(F.col(text_col)).alias("at"), F.xxhash64(F.lit(seed + 1), F.col(id_col)).alias("turn")
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        model = FTRL(bits, **options)
        group = group.sort_values(["turn", "label"], kind="stable")
        packed_rows, labels = group["at"].tolist(), group["label"].tolist()
        order = np.random.default_rng(seed)
        for k in range(passes):
            for i in range(len(labels)) if k == 0 else order.permutation(len(labels)):
                model.learn(np.frombuffer(packed_rows[i], "<u4"), int(labels[i]), toxic_weight if labels[i] else 1.0)
        everywhere = model.weights(np.arange(len(model.z)))
        used = np.flatnonzero(everywhere)
        return pd.DataFrame({"bucket": used, "weight": everywhere[used]})

    return sample.groupBy(F.lit(1).alias("all")).applyInPandas(fit, "bucket long, weight double").toPandas()  # at most 2**bits + 1 rows


def score(text: Column, weights: pd.DataFrame, spark, bits: int = 20) -> Column:
    """Probability of label 1, from the whole text; a text without letters gets the bias alone."""
    at, w = weights["bucket"].to_numpy(np.int64), weights["weight"].to_numpy(np.float64)
    order = np.argsort(at)
    shared = spark.sparkContext.broadcast((at[order], w[order]))

    @F.pandas_udf(T.DoubleType())
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, value = shared.value
        dense = np.zeros((1 << bits) + 1, np.float32)
        dense[known] = value
        for texts in parts:
            total = np.array([dense[features(t, bits)].sum(dtype=np.float64) for t in texts]) + dense[-1]
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))))

    return of(text)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 20, **options
) -> DataFrame:
    """One row per row of ``docs``: ``(id, held_out, score, predicted)``.

    Learns from labelled rows outside the held-out fold only, and from texts only. A null or
    empty text is scored by the bias. Rows that repeat an id are scored one by one; an id
    with several labels takes the largest, so that it counts once. Without any label all
    scores are 0.5 and predicted is 1. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("label_here"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = own.join(usable, own["id"] == usable["label_id"]).select("id", "text", F.col("label_here").alias("label"))
    weights = train(rows, "id", "text", "label", rows.select("id").count(), bits=bits, **options)
    scored = own.select("id", held_out(F.col("id")).alias("held_out"), score(F.col("text"), weights, spark, bits).alias("score"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
