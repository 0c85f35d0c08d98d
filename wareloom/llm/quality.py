"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector; learned filters of eight bytes step over the
whole text; each half-overlapping chunk keeps the maximum of every filter; a
document's probability is a logistic function of the largest and of the mean
chunk maximum per filter. Texts are scored batch by batch where they lie;
only the fitted weights (a few kilobytes) go to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.llm.common import fold, labelled_sample

DIM = 8
WIDTH = 8
STRIDE = 4
FILTERS = 32
#: Positions of half a chunk; chunks of two halves overlap by one.
HALF = 64
#: Bytes that are convolved at once; the windows across a border belong to the earlier piece.
PIECE = 1 << 20
#: Labelled rows per class that the network is fitted on, at most.
SAMPLE_ROWS = 1500
EPOCHS = 12
FOLDS = 3
HELD = 1


@dataclass
class Network:
    table: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    shift: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    bias: float

    def halves(self, data: bytes, places: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Filter maxima of each half chunk; with `places`, where they stand."""
        raw = np.frombuffer(data, np.uint8)
        positions = max(1, -(-(len(raw) - WIDTH) // STRIDE) + 1)
        raw = np.pad(raw, (0, positions * STRIDE + WIDTH - len(raw) + STRIDE))
        top, where = [], []
        step = PIECE // STRIDE // HALF * HALF
        for at in range(0, positions, step):
            m = min(step, positions - at)
            x = self.table[raw[at * STRIDE : (at + m) * STRIDE + WIDTH]].reshape(-1, STRIDE * DIM)
            y = x[:m] @ self.filters[: STRIDE * DIM]
            y += x[1 : m + 1] @ self.filters[STRIDE * DIM :]
            starts = np.arange(0, m, HALF)
            top.append(np.maximum.reduceat(y, starts, axis=0))
            if places:
                where += [at + s + y[s : s + HALF].argmax(axis=0) for s in starts]
        return np.maximum(np.concatenate(top) + self.shift, 0), np.array(where) if places else None, raw

    def features(self, top: np.ndarray) -> np.ndarray:
        chunks = np.maximum(top[:-1], top[1:]) if len(top) > 1 else top
        return np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])

    def score(self, text: str | None) -> float:
        top, _, _ = self.halves((text or "").encode("utf-8", "replace"))
        return float(1 / (1 + np.exp(-np.clip(self.features(top) @ self.out + self.bias, -30, 30))))


def fit(sample: list[tuple[int, str, int]], epochs: int = EPOCHS) -> Network:
    """Adam on the logistic loss, both classes with equal weight; the same sample
    gives the same network. Without any row every score is 0.5."""
    draw = np.random.default_rng(11)
    net = Network(
        draw.normal(0, 0.5, (256, DIM)).astype(np.float32),
        draw.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        np.zeros(2 * FILTERS, np.float32),
        0.0,
    )
    n1 = sum(y for _, _, y in sample)
    weight = {0: 0.5 / max(1, len(sample) - n1), 1: 0.5 / max(1, n1)}
    net.out += draw.normal(0, 0.1, 2 * FILTERS).astype(np.float32) * bool(sample)
    data = [(t.encode("utf-8", "replace"), y) for _, t, y in sample]
    names = ("table", "filters", "shift", "out", "bias")
    first = {n: np.zeros_like(getattr(net, n), dtype=np.float64) for n in names}
    second = {n: np.zeros_like(getattr(net, n), dtype=np.float64) for n in names}
    batch, step = 24, 0
    for _ in range(epochs * max(1, 400 // max(1, len(data)))):
        order = draw.permutation(len(data))
        for at in range(0, len(order), batch):
            grad = {n: np.zeros_like(getattr(net, n), dtype=np.float64) for n in names}
            for d in order[at : at + batch]:
                text, y = data[d]
                if y and draw.random() < 0.6:  # a part of a good text is good as well: short texts are learned too
                    n = int(np.exp(draw.uniform(np.log(8), np.log(2000))))
                    start = int(draw.integers(0, max(1, len(text) - n)))
                    text = text[start : start + n]
                top, where, raw = net.halves(text, places=True)
                feats = net.features(top)
                p = 1 / (1 + np.exp(-np.clip(feats @ net.out + net.bias, -30, 30)))
                g = (p - y) * weight[y] * len(data) / batch
                grad["out"] += g * feats
                grad["bias"] += g
                d_max, d_mean = g * net.out[:FILTERS], g * net.out[FILTERS:]
                d_top = np.zeros_like(top, dtype=np.float64)
                cols = np.arange(FILTERS)
                d_top[top.argmax(axis=0), cols] += d_max
                if len(top) > 1:
                    later = top[1:] > top[:-1]
                    share = d_mean / (len(top) - 1)
                    d_top[1:] += np.where(later, share, 0)
                    d_top[:-1] += np.where(later, 0, share)
                else:
                    d_top += d_mean
                d_top *= top > 0
                h, f = np.nonzero(d_top)
                if not len(h):
                    continue
                v = d_top[h, f]
                window = raw[where[h, f][:, None] * STRIDE + np.arange(WIDTH)]
                vectors = net.table[window].reshape(len(h), -1)
                np.add.at(grad["filters"].T, f, v[:, None] * vectors)
                np.add.at(grad["shift"], f, v)
                np.add.at(grad["table"], window.ravel(), (v[:, None] * net.filters.T[f]).reshape(-1, DIM))
            step += 1
            for n in names:
                value = getattr(net, n)
                gr = grad[n] + 1e-4 * value
                first[n] = 0.9 * first[n] + 0.1 * gr
                second[n] = 0.99 * second[n] + 0.01 * gr * gr
                move = 0.004 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
                setattr(net, n, (value - move).astype(np.float32) if n != "bias" else float(value - move))
    return net


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    """Fit on at most `rows` labelled documents of each class outside the held-out fold."""
    return fit(labelled_sample(documents, labels, "quality", FOLDS, HELD, rows))


def scores(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, text -> doc_id, held_out, score, predicted.

    A null text scores like an empty one. Rows with the same doc_id are
    scored each for itself; an empty table gives no row; columns other than
    doc_id and text are ignored.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": [net.score(t) for t in frame["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string")).mapInPandas(work, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def good(docs: DataFrame, net: Network, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score at least `least`."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([net.score(t) >= least for t in texts], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
