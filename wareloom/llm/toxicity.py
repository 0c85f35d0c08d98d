"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, word pairs and pairs with one word between of the
whole text, each present or not, hashed to 2**20 places. Training goes over
the sample one document at a time with a learning rate per coordinate; L1
leaves few weights that are not zero, and only these go to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.llm.common import fold, labelled_sample

BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 20.0, 0.5
#: Labelled rows per class that the weights are fitted on, at most.
SAMPLE_ROWS = 4000
EPOCHS = 6
FOLDS = 5
HELD = 0

_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def features(text: str | None) -> np.ndarray:
    """Places of all words, pairs and skip pairs of the whole text, repeats included."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    mix = np.uint64(0x9E3779B97F4A7C15)
    pairs = (h[:-1] * mix) ^ (h[1:] >> np.uint64(3))
    skips = (h[:-2] * mix) ^ (h[2:] >> np.uint64(7)) ^ mix
    return (np.concatenate([h, pairs * mix, skips * mix]) >> np.uint64(64 - BITS)).astype(np.int64)


class Weights:
    """The weights that are not zero, and the bias."""

    def __init__(self, places: np.ndarray, values: np.ndarray, bias: float) -> None:
        self.places, self.values, self.bias = places, values, bias
        self.dense: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None}

    def score(self, text: str | None) -> float:
        if self.dense is None:
            self.dense = np.zeros(1 << BITS, np.float32)
            self.dense[self.places] = self.values
        at = features(text)
        at = np.unique(at[self.dense[at] != 0])
        total = self.bias + float(self.dense[at].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fit(sample: list[tuple[int, str, int]], epochs: int = EPOCHS) -> Weights:
    """The same sample gives the same weights; without any row every score is 0.5."""
    rows = [(np.unique(features(t)), y) for _, t, y in sample]
    n1 = sum(y for _, y in rows)
    weight = {0: 0.5 * len(rows) / max(1, len(rows) - n1), 1: 0.5 * len(rows) / max(1, n1)}
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last place is the bias

    def current(at: np.ndarray) -> np.ndarray:
        rest = np.sign(z[at]) * L1 - z[at]
        w = rest / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where((np.abs(z[at]) <= L1) & (at < 1 << BITS), 0.0, np.where(at < 1 << BITS, w, -z[at] / ((BETA + np.sqrt(n[at])) / ALPHA)))

    draw = np.random.default_rng(5)
    for _ in range(epochs * max(1, 1000 // max(1, len(rows)))):
        for i in draw.permutation(len(rows)):
            at, y = np.append(rows[i][0], 1 << BITS), rows[i][1]
            w = current(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y) * weight[y]
            more = np.sqrt(n[at] + g * g) - np.sqrt(n[at])
            z[at] += g - more / ALPHA * w
            n[at] += g * g
    every = current(np.arange((1 << BITS) + 1))
    places = np.flatnonzero(every[:-1])
    return Weights(places, every[places].astype(np.float32), float(every[-1]))


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Weights:
    """Fit on at most `rows` labelled documents of each class outside the held-out fold."""
    return fit(labelled_sample(documents, labels, "toxic", FOLDS, HELD, rows))


def scores(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, text -> doc_id, held_out, score, predicted.

    A null text scores like an empty one: by the bias alone. Rows with the
    same doc_id are scored each for itself; an empty table gives no row;
    columns other than doc_id and text are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # at most 2**20 places

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": [sent.value.score(t) for t in frame["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string")).mapInPandas(work, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
