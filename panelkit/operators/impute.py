"""Chained-equation imputation (MICE) fitted from second moments.

Each step regresses one column on all others, over the rows where it is observed. The regression
needs only the moments of those rows: one Spark aggregate, whose result is one small matrix. The
fitted model is the list of steps. Applying it replays the list on a row's original cells, so no
intermediate state is cached, checkpointed or lost with an executor, and new data gets exactly
the treatment the training data had. Noise is drawn from a hash of the row's key and the step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.operators import profile
from panelkit.session import right_size, sum_arrays
from panelkit.sources import artifacts

LOWEST, HIGHEST = -50.0, 300.0  # fixed values: range imputed cells must stay in


@dataclass
class Step:
    """One regression: ``target ~ intercept + coef . others`` with its posterior spread."""

    target: int
    intercept: float
    coef: np.ndarray
    centre: np.ndarray
    spread: np.ndarray | None
    noise: float

    def plain(self) -> tuple:
        """As arrays and numbers, which executors can unpickle without this package."""
        return self.target, self.intercept, self.coef, self.centre, self.spread, self.noise


def _bits(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit words (splitmix64 finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _normals(rows: np.ndarray, step: int, attempt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        word = _bits(rows ^ _bits(np.full(1, (step << 8) + attempt, dtype="uint64")))
        u1 = ((word >> np.uint64(11)).astype("float64") + 1.0) / 2.0 ** 53
        u2 = (_bits(word) >> np.uint64(11)).astype("float64") / 2.0 ** 53
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)


def _draw(mean, sd, rows, step):
    """Normal draws kept inside the allowed range by drawing again."""
    value = mean + sd * _normals(rows, step, 0)
    for attempt in range(1, 24):
        out = ((value < LOWEST) | (value > HIGHEST)) & (mean >= LOWEST) & (mean <= HIGHEST)
        if not out.any():
            break
        value[out] = mean[out] + sd[out] * _normals(rows[out], step, attempt)
    return np.clip(value, LOWEST, HIGHEST)


def _replay(x: np.ndarray, rows: np.ndarray, start: np.ndarray, steps: Sequence[tuple]) -> np.ndarray:
    missing = np.isnan(x)
    filled = np.where(missing, start, x)
    for number, (target, intercept, coef, centre, spread, noise) in enumerate(steps):
        at = np.flatnonzero(missing[:, target])
        if not len(at):
            continue
        others = np.delete(filled[at], target, axis=1)
        value = np.clip(intercept + others @ coef, LOWEST, HIGHEST)
        if spread is not None:
            centred = others - centre
            sd = np.sqrt(np.maximum((centred @ spread * centred).sum(axis=1) + noise, 0.0))
            value = _draw(intercept + others @ coef, sd, rows[at], number)
        filled[at, target] = value
    return filled


def bayesian_ridge(n: float, gram: np.ndarray, cross: np.ndarray, square: float,
                   max_iter: int = 300, tol: float = 1e-3):
    """Evidence maximisation (MacKay 1992) from centred moments: ``(coef, spread, noise)``."""
    eps = 1e-6
    eig, vec = np.linalg.eigh(gram)
    eig = np.maximum(eig, 0.0)
    rotated = vec.T @ cross
    alpha, lam, old = 1.0 / (square / n + np.finfo(float).eps), 1.0, None
    for _ in range(max_iter):
        coef = vec @ (rotated / (eig + lam / alpha))
        residual = max(square - 2.0 * coef @ cross + coef @ gram @ coef, 0.0)
        gamma = np.sum(alpha * eig / (lam + alpha * eig))
        lam = (gamma + 2 * eps) / (coef @ coef + 2 * eps)
        alpha = (n - gamma + 2 * eps) / (residual + 2 * eps)
        if old is not None and np.abs(old - coef).sum() < tol:
            break
        old = coef
    coef = vec @ (rotated / (eig + lam / alpha))
    spread = (vec / (alpha * eig + lam)) @ vec.T
    return coef, spread, 1.0 / alpha


def gram_matrix(df: DataFrame, columns: Sequence[str], prepare=None, parts: int = 1,
                select=None) -> np.ndarray:
    """Second moments of ``[1, x]`` as ``parts`` matrices, summed over all rows on Spark.

    ``prepare(pdf) -> matrix`` may derive the rows; ``select(matrix, pdf, part)`` picks the rows
    of each part. Default: all rows without a missing value.
    """
    size = len(columns) + 1

    def partial(batches):
        total = np.zeros((parts, size, size))
        for pdf in batches:
            x = prepare(pdf) if prepare else pdf[list(columns)].to_numpy("float64")
            for p in range(parts):
                rows = select(x, pdf, p) if select else x[~np.isnan(x).any(axis=1)]
                z = np.hstack([np.ones((len(rows), 1)), rows])
                total[p] += z.T @ z
        yield pd.DataFrame({"v": [total.ravel()]})

    total = sum_arrays(df.mapInPandas(partial, "v array<double>"), parts * size * size)
    return total.reshape(parts, size, size)


def mean_products(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, mean_product)`` for all pairs of ``[one, *columns]``, over the rows without a missing value.

    One aggregate of products, then one row per pair.
    """
    names = ["one", *columns]
    rows = df.select(F.lit(1.0).alias("one"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.agg(*[F.avg(F.col(names[i]) * F.col(names[j])).alias(f"_{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"),
                               F.col(f"_{min(i, j)}_{max(i, j)}").alias("mean_product"))
                      for i in range(len(names)) for j in range(len(names))])
    return sums.select(F.inline(cells))


@dataclass
class ChainedImputer:
    """MICE with Bayesian ridge regressions, median start and posterior draws.

    ``schedule="block"`` fits all columns of a sweep from one job. ``"sequential"`` refits after every
    column, as the method is defined: one job per column and sweep, each of which replays the steps so far; it is
    for few rows. Without a missing cell there is nothing to fit and no job beyond counting.
    """

    features: Sequence[str] | None = None
    max_iter: int = 10
    seed: int = 42
    sample_posterior: bool = True
    schedule: str = "block"
    steps: list = field(default_factory=list)
    start: np.ndarray | None = None
    columns: list | None = None

    def _rows(self, df: DataFrame, key: str) -> DataFrame:
        present = {c: (F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c)
                   for c in self.columns}
        return df.select(F.xxhash64(F.lit(self.seed), F.col(key).cast("string")).alias("_row"),
                         *present.values())

    def fit(self, df: DataFrame, key: str) -> "ChainedImputer":
        self.columns = profile.numeric_columns(df, self.features)
        if not self.features:
            self.columns = [c for c in self.columns if c != key]
        names, width = list(self.columns), len(self.columns)
        cached = self._rows(df, key).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            data = right_size(cached)
            counts = data.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_n{i}") for i, c in enumerate(names)]).first()
            known = counts[1:]
            if min(known, default=counts[0]) == counts[0]:
                self.start, self.steps = np.zeros(width), []
                return self
            middle = {r["feature"]: r["median"] for r in profile.medians(data, names).collect()}
            self.start = np.array([middle.get(c) if middle.get(c) is not None else 0.0 for c in names])
            order = sorted((j for j in range(width) if known[j] > 0), key=lambda j: (-known[j], j))
            self.steps = []
            for _ in range(self.max_iter):
                for targets in [order] if self.schedule == "block" else [[j] for j in order]:
                    self.steps += self._moments(data, names, targets)
        finally:
            cached.unpersist()
        return self

    def _moments(self, data: DataFrame, names: list, targets: Sequence[int]) -> list[Step]:
        start, steps = self.start, [s.plain() for s in self.steps]

        def prepare(pdf):
            x = pdf[names].to_numpy("float64")
            rows = pdf["_row"].to_numpy("int64").view("uint64")
            # Moments around the start values keep the sums well conditioned.
            return _replay(x, rows, start, steps) - start

        def observed(x, pdf, part):
            return x[pdf[names[targets[part]]].notna().to_numpy()]

        moments = gram_matrix(data, names, prepare, len(targets), observed)
        return [self._solve(m, j) for m, j in zip(moments, targets)]

    def _solve(self, m: np.ndarray, j: int) -> Step:
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        cov = m[1:, 1:] - n * np.outer(mean, mean)
        others = np.delete(np.arange(len(mean)), j)
        coef, spread, noise = bayesian_ridge(
            n, cov[np.ix_(others, others)], cov[others, j], max(cov[j, j], 0.0))
        centre = (mean + self.start)[others]
        return Step(j, float((mean + self.start)[j] - coef @ centre), coef, centre,
                    spread if self.sample_posterior else None, float(noise))

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        """Fill the fitted columns; absent ones are added, observed cells stay untouched."""
        if self.columns is None:
            raise RuntimeError("fit the imputer before transforming")
        for c in self.columns:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("double"))
        df = df.withColumns({c: F.col(c).cast("double") for c in self.columns})
        names, start = list(self.columns), self.start
        sent = df.sparkSession.sparkContext.broadcast([s.plain() for s in self.steps])
        source = df.withColumn("_row", F.xxhash64(F.lit(self.seed), F.col(key).cast("string")))

        def fill(batches):
            for pdf in batches:
                rows = pdf.pop("_row").to_numpy("int64").view("uint64")
                pdf[names] = _replay(pdf[names].to_numpy("float64"), rows, start, sent.value)
                yield pdf

        return source.mapInPandas(fill, df.schema)

    def to_arrays(self) -> dict[str, np.ndarray]:
        """The fitted steps as named arrays; columns are named in order."""
        arrays = {"start": self.start, "seed": np.array([self.seed]), "count": np.array([len(self.steps)])}
        arrays |= {f"column:{c}": np.array([i]) for i, c in enumerate(self.columns)}
        for i, s in enumerate(self.steps):
            arrays |= {f"{i}:one": np.array([s.target, s.intercept, s.noise]), f"{i}:coef": s.coef,
                       f"{i}:centre": s.centre}
            if s.spread is not None:
                arrays[f"{i}:spread"] = s.spread
        return arrays

    @classmethod
    def from_arrays(cls, a: Mapping[str, np.ndarray], seed: int | None = None) -> "ChainedImputer":
        columns = sorted((n for n in a if n.startswith("column:")), key=lambda n: a[n][0])
        steps = [Step(int(a[f"{i}:one"][0]), float(a[f"{i}:one"][1]), a[f"{i}:coef"], a[f"{i}:centre"],
                      a.get(f"{i}:spread"), float(a[f"{i}:one"][2])) for i in range(int(a["count"][0]))]
        names = [c.partition(":")[2] for c in columns]
        return cls(names, seed=int(a["seed"][0]) if seed is None else seed, steps=steps, start=a["start"], columns=names)

    def save(self, spark: SparkSession, path: str) -> None:
        """The fitted steps as one small table."""
        artifacts.save(spark, path, self.to_arrays())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ChainedImputer":
        return cls.from_arrays(artifacts.load(spark, path))

    def fit_transform(self, df: DataFrame, key: str) -> DataFrame:
        return self.fit(df, key).transform(df, key)
