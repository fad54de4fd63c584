"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words, pairs of neighbours, and pairs with one word between. FTRL-proximal keeps a learning
rate for every coordinate and zeroes weights that don't earn their L1 cost, so the model that scores a corpus is a compact
table with a proven bound (``BUCKETS``), broadcast to all tasks. It is fitted by one task on a bounded sample of the labelled rows
(``MAX_LABELLED`` rows or so, and ``MAX_BYTES`` of features or so, by a seeded hash of the key); scoring reads whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, unit_hash

BUCKETS = 1 << 22
MAX_LABELLED, MAX_BYTES = 20_000, 200 << 20
WORDS = re.compile(r"[^\W_]+").findall


class Hashes(dict):
    """Word -> 32-bit hash; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = crc32(word.encode())
        return out


def buckets(text: str | None, hashes: Hashes) -> np.ndarray:
    """Feature buckets of a text, repeats included."""
    words = WORDS(text.lower()) if text else []
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    pairs = (h[:-1] * a + h[1:]) * b
    skips = (h[:-2] * c + h[2:] + a) * b
    return (np.concatenate(((h + c) * a, pairs, skips)) >> np.uint64(64 - 22)).astype(np.int64)


@dataclass
class Model:
    """Sparse weights: sorted buckets, their values, and the bias."""

    at: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.float32)
        out[self.at] = self.weights
        return out


def ftrl(rows: list[tuple[np.ndarray, int]], alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 1.0, passes: int = 8, least: int = 3) -> Model:
    """FTRL-proximal over rows of distinct buckets and a label; the last bucket is the bias, without L1.

    Buckets of fewer than ``least`` rows are left out: they could only memorise those rows.
    """
    seen = np.zeros(BUCKETS, dtype=np.int32)
    for features, _ in rows:
        seen[features] += 1
    for i, (f, y) in enumerate(rows):  # in place: the fuller features go as they are replaced
        rows[i] = f[seen[f] >= least], y
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    cost = np.full(BUCKETS + 1, l1)
    cost[BUCKETS] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        own = z[i]
        return np.where(np.abs(own) <= cost[i], 0.0, -(own - np.sign(own) * cost[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(passes):
        for features, label in rows:
            i = np.append(features, BUCKETS)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(BUCKETS + 1))
    at = np.flatnonzero(w[:-1])
    return Model(at, w[at].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", most: int = MAX_LABELLED, seed: int = 11) -> Model:
    """A model from the labelled rows; a key labelled more than once counts as 1 if any of its labels is.

    At most about ``most`` rows are used, chosen by hash; so the labels are broadcast and the texts are not shuffled. One
    task fits the model, from features that other tasks have made.
    """
    labelled = materialise(labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y")).withColumn("u", unit_hash("key", seed)), "labels")
    share = min(1.0, most / max(1, labelled.count()))
    sample = labelled if share == 1 else labelled.filter(F.col("u") < int(share * 2**62) * 2)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            yield pd.DataFrame({"u": batch["u"], "y": batch["y"], "f": [np.unique(buckets(t, hashes)).astype(np.int32).tobytes() for t in batch["t"]]})

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(u, np.frombuffer(f, np.int32), y) for batch in batches for u, f, y in zip(batch["u"], batch["f"], batch["y"])]
        rows.sort(key=lambda r: (r[0], r[2], r[1].tobytes()))
        rows[:] = [(f, y) for _, f, y in rows]
        model = ftrl(rows)
        yield pd.DataFrame({"at": np.append(model.at, BUCKETS), "w": np.append(model.weights, model.bias)})

    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).join(F.broadcast(sample), "key").select("u", "y", "t")
    made = materialise(texts.mapInPandas(extract, "u long, y int, f binary"), "features")
    held = made.agg(F.sum(F.octet_length("f"))).first()[0] or 0
    if held > MAX_BYTES:
        made = made.filter(F.col("u") < int(share * MAX_BYTES / held * 2**62) * 2)
    weights = made.coalesce(1).mapInPandas(train, "at long, w double").toPandas().sort_values("at")
    return Model(weights["at"].to_numpy()[:-1], weights["w"].to_numpy()[:-1], float(weights["w"].iloc[-1]) if len(weights) else 0.0)


def scorer(docs: DataFrame, model: Model):
    """A Column -> Column function: text to the probability of the label."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense, hashes = shared.value.dense(), Hashes()
        for batch in batches:
            out = []
            for t in batch:
                i = buckets(t, hashes)
                i = np.unique(i[dense[i] != 0])  # few carry a weight
                out.append(1 / (1 + np.exp(-np.clip(shared.value.bias + dense[i].sum(dtype=np.float64), -35, 35))))
            yield pd.Series(out, dtype="float64")

    return score


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, score, predicted.

    Null and empty texts score by the bias alone; repeated rows score alike; an empty table gives no rows; without any label
    every score is one half; other columns are left out.
    """
    scored = docs.select(F.col(key), scorer(docs, model)(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
