"""Whiten embeddings by the covariance of their distinct grid vectors.

Every vector is rounded down to a grid (`cells` steps a unit). Equal grid
vectors are grouped, and each group counts once, or as often as it occurs
(`weights`), in the fit: exact integer sums give the mean, a weighted GEMM of
centred rows per task gives partial covariances that merge by row of the
matrix. Only the covariance, a square of the vector's length, comes to the
driver, where its leading eigenvectors are taken. Each distinct vector is
whitened once and joined back to the rows that have it.

Null vectors and vectors with null or non-finite components are left out.
Vectors of another length make a fit of their own; an empty vector has no
component and so no row. A component without spread (one distinct vector, or
fewer dimensions than vectors span) has null `whitened`, and `explained` is
null where there is no spread at all. `deviation` is null where it is no long.
Rows that share an id stay apart, an empty table gives no row, and other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.session import staged

#: Steps of the grid a unit.
CELLS = 256
COMPONENTS = 4
#: Partial covariance rows that meet in one task at most, per row of the matrix.
MERGE = 64
#: Eigenvalues below this share of the largest one count as no spread.
NO_SPREAD = 1e-13


def grid(vector: Column, cells: int = CELLS) -> Column:
    """Components as double, times cells, rounded down; null for vectors that take no part."""
    usable = vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * cells)))


def distinct_vectors(rows: DataFrame, weights: str = "one") -> DataFrame:
    """x -> dims, x, w: one row per distinct grid vector.

    w is its weight in the fit: 1, or with weights="counts" the number of its
    rows. Copies are folded before the shuffle.
    """
    w = {"one": F.lit(1), "counts": F.count(F.lit(1))}[weights]
    return rows.groupBy("x").agg(w.cast("long").alias("w")).select(F.size("x").alias("dims"), "x", "w")


def _packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, dtype=np.float64).tobytes()


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64, copy=False)


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per length: weight and weighted sums of every dimension, exact as Python integers."""
    total: dict[int, np.ndarray] = {}
    for frame in frames:
        for dims, part in frame.groupby("dims"):
            x, w = _matrix(part["x"]).astype(object), part["w"].to_numpy().astype(object)
            now = np.concatenate([[w.sum()], w @ x])
            total[dims] = total.get(dims, 0) + now
    for dims, s in total.items():
        yield pd.DataFrame({"dims": dims, "at": range(len(s)), "s": [str(v) for v in s]})


def _partial_covariance(frames: Iterator[pd.DataFrame], means: dict[int, np.ndarray], column: str) -> Iterator[pd.DataFrame]:
    """Per length: this task's sum of w * c c' over its centred rows c, by row of the matrix."""
    total: dict[int, np.ndarray] = {}
    salt = TaskContext.get().partitionId() % MERGE
    for frame in frames:
        for dims, part in frame.groupby("dims"):
            c = np.stack(part[column].to_numpy()).astype(np.float64) - means[dims]
            total[dims] = total.get(dims, 0.0) + (c * part["w"].to_numpy()[:, None]).T @ c
    for dims, v in total.items():
        yield pd.DataFrame({"dims": dims, "row": range(len(v)), "salt": salt, "v": [_packed(r) for r in v]})


def _merge(keys: list[str]):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        one = frame.iloc[:1][["dims", "row", "salt"]].copy()
        if "salt" not in keys:
            one["salt"] = 0
        one["v"] = [_packed(np.sum([np.frombuffer(b) for b in frame["v"]], axis=0))]
        return one

    return run


def _covariance(rows: DataFrame, means: dict[int, np.ndarray], weight: dict[int, int], column: str) -> dict[int, np.ndarray]:
    """The weighted covariance of a column of vectors, per length.

    Each task sends one partial matrix, in rows; these meet in two steps, so
    that no task adds up the partial rows of all tasks.
    """
    kind = "dims int, row int, salt int, v binary"
    parts = rows.mapInPandas(lambda frames: _partial_covariance(frames, means, column), kind)
    for keys in (["dims", "row", "salt"], ["dims", "row"]):
        parts = parts.groupBy(*keys).applyInPandas(_merge(keys), kind)
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.collect():
        found.setdefault(r["dims"], {})[r["row"]] = np.frombuffer(r["v"])
    return {d: np.stack([v[i] for i in sorted(v)]) / weight[d] for d, v in found.items()}


def _leading(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their unit vectors as columns; the first largest entry is positive."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    sign = np.sign(u[np.abs(u).argmax(axis=0), range(u.shape[1])])
    return np.where(e > NO_SPREAD * max(e[0], 0.0), e, 0.0), u * sign


class Fit:
    """What one length's vectors give: n, S, leading eigenvalues and vectors, trace."""

    def __init__(self, n: int, sums: list[int], v: np.ndarray, components: int):
        self.n, self.sums = n, sums
        self.mean = np.array([s / n for s in sums])
        self.e, self.u = _leading(v, components)
        self.trace = float(np.trace(v))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) on every component, over its standard deviation; 0 without spread."""
        scale = np.where(self.e > 0, np.sqrt(self.e), np.inf)
        return (x.astype(np.float64) - self.mean) @ self.u / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) squared, exact; None where it is no long."""
        s = np.array(self.sums, dtype=object)
        widest = int(max(self.n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, self.sums), default=0), 1))
        if x.shape[1] * widest * widest < 1 << 63:
            return list(((self.n * x - s.astype(np.int64)) ** 2).sum(axis=1))
        exact = [int(((self.n * row.astype(object) - s) ** 2).sum()) for row in x]
        return [d if d < 1 << 63 else None for d in exact]


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """One Fit per vector length, over the weighted distinct vectors."""
    sums: dict[int, dict[int, int]] = {}
    parts = distinct.mapInPandas(_sums, "dims int, at int, s string")
    for r in parts.groupBy("dims", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        sums.setdefault(r["dims"], {})[r["at"]] = int(r["s"])
    n = {d: s[0] for d, s in sums.items()}
    exact = {d: [s[i] for i in range(1, len(s))] for d, s in sums.items() if d}
    means = {d: np.array([v / n[d] for v in s]) for d, s in exact.items()}
    v = _covariance(distinct.where("dims > 0"), means, n, "x") if exact else {}
    return {d: Fit(n[d], exact[d], v[d], components) for d in exact}


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "one", cells: int = CELLS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.

    `vectors` has vec_id and embedding. One row per usable vector and
    component, components from 1 by falling eigenvalue. identity_error is the
    largest absolute entry of the whitened vectors' covariance minus the
    identity, over all lengths and the components that have spread.
    """
    spark = vectors.sparkSession
    rows = staged(
        vectors.select(F.col("vec_id").alias("vec_id"), grid(F.col("embedding"), cells).alias("x")).where("x is not null"), "whiten-grid"
    )
    distinct = staged(distinct_vectors(rows, weights), "whiten-distinct")
    fits = fit(distinct, components)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dims, part in frame.groupby("dims"):
                x, model = _matrix(part["x"]), fits[dims]
                yield pd.DataFrame(
                    {"dims": dims, "x": list(x), "w": part["w"], "deviation": pd.array(model.deviation(x), dtype="Int64"), "white": list(model.whitened(x))}
                )

    kind = "dims int, x array<bigint>, w long, deviation long, white array<double>"
    white = staged(distinct.where("dims > 0").mapInPandas(score, kind), "whiten-scores")
    error = _identity_error(white, fits)
    table = spark.createDataFrame(
        [
            (d, k + 1, bool(m.e[k] > 0), m.n, float(m.e[k]) / m.trace if m.trace > 0 else None, error)
            for d, m in fits.items()
            for k in range(len(m.e))
        ],
        "dims int, component int, spread boolean, n long, explained double, identity_error double",
    )
    per_row = rows.join(white.select("x", "dims", "deviation", "white"), "x")
    return per_row.join(F.broadcast(table), "dims").select(
        "vec_id",
        "component",
        "n",
        "deviation",
        F.when(F.col("spread"), F.element_at("white", F.col("component"))).alias("whitened"),
        "explained",
        "identity_error",
    )


def _identity_error(white: DataFrame, fits: dict[int, Fit]) -> float | None:
    """Largest absolute entry of the whitened covariance minus the identity; null without any spread.

    The mean of the whitened vectors is taken from the data as well.
    """
    if not fits:
        return None
    total = {}
    weight = F.col("w").cast("double")
    by_place = white.select("dims", "w", F.posexplode("white").alias("at", "c")).groupBy("dims", "at")
    for r in by_place.agg((F.sum(F.col("c") * weight) / F.sum(weight)).alias("m")).collect():
        total.setdefault(r["dims"], {})[r["at"]] = r["m"]
    means = {d: np.array([m[i] for i in sorted(m)]) for d, m in total.items()}
    worst = None
    for d, v in _covariance(white, means, {d: f.n for d, f in fits.items()}, "white").items():
        have = fits[d].e > 0
        if have.any():
            off = float(np.abs(v[np.ix_(have, have)] - np.eye(int(have.sum()))).max())
            worst = off if worst is None else max(worst, off)
    return worst
