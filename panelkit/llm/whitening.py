"""Whitening of embeddings: eigenvectors of their covariance from a pivoted Cholesky factor.

Entries become whole numbers, and each distinct vector counts once. Its products are summed in whole numbers about
the nearest whole mean, so that nothing cancels and the sums don't depend on partitions or retries; the remaining
shift is taken off exactly. The covariance is factored by Cholesky with diagonal pivots, and one-sided Jacobi
rotations make the columns of the triangular factor orthogonal: their squared norms are the eigenvalues, the
normalised columns the components. Small eigenvalues keep their relative precision that way.

Vectors meet nobody: tasks send sums of products, of which the driver holds one for each pair of dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm import common

COMPONENTS = 4
#: Whole numbers are floors of entries times this.
GRID = 256
#: Sweeps of rotations at most; columns count as orthogonal below this cosine.
SWEEPS = 60
ORTHOGONAL = 4e-16
EXACT = 1 << 53
LONGEST = (1 << 63) - 1


def whole(vectors: DataFrame, vector_col: str = "embedding", name: str = "x") -> DataFrame:
    """``vectors`` with ``name``: the entries on the grid, as longs; rows without a usable vector are left out.

    A vector that is null or empty or holds a null or non-finite entry isn't usable. Entries beyond a long end at its
    limits. All other columns pass through by position, whatever their names.
    """
    named = [f"mk_{i}" for i in range(len(vectors.columns))]
    v = F.col(named[vectors.columns.index(vector_col)])
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    grid = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(GRID))) + F.lit(0).cast("long"))
    usable = vectors.toDF(*named).where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)))
    return usable.select("*", grid.alias("mk_x")).toDF(*vectors.columns, name)


def matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), wide)


def _product_batches(centre: list[int]) -> Callable:
    """(i, j, s): this task's sum of products of entries i <= j about the centre."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = len(centre)
        total = np.zeros((wide, wide), object)
        for batch in batches:
            x = matrix(batch.column(0), wide)
            for at in range(0, len(x), 4096):
                part = x[at:at + 4096]
                high = max((max(abs(int(c.max()) - m), abs(int(c.min()) - m)) for c, m in zip(part.T, centre)),
                           default=0)
                if high * high * len(part) < EXACT:
                    # Whole numbers below 2^53 add up exactly in floating point.
                    y = (part - np.array(centre, np.int64)).astype(np.float64)
                    total += (y.T @ y).astype(np.int64).astype(object)
                else:
                    y = part.astype(object) - np.array(centre, object)
                    total += y.T @ y
        i, j = np.triu_indices(wide)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(s) for s in total[i, j]], pa.string())],
            names=["i", "j", "s"])
    return products


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """Columns l with v = l @ l.T, found by largest remaining diagonal; as many as v has rank.

    Rows stay in their order: sorted by their pivots they make the factor triangular.
    """
    n = len(v)
    diagonal, factor, done = np.diag(v).copy(), np.zeros((n, n)), np.zeros(n, bool)
    least = n * np.finfo(float).eps * diagonal.max(initial=0.0)
    for k in range(n):
        pivot = int(np.argmax(np.where(done, -np.inf, diagonal)))
        if diagonal[pivot] <= least:
            return factor[:, :k]
        column = np.where(done, 0.0, v[:, pivot] - factor[:, :k] @ factor[pivot, :k])
        column[pivot] = diagonal[pivot]
        factor[:, k] = column / np.sqrt(diagonal[pivot])
        done[pivot] = True
        diagonal = diagonal - factor[:, k] ** 2
    return factor


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """``factor`` times an orthogonal matrix, with orthogonal columns.

    A sweep pairs all columns in rounds of disjoint pairs, which rotate together.
    """
    a = factor.T.copy()
    if len(a) % 2:
        a = np.vstack([a, np.zeros((1, a.shape[1]))])
    seats = np.arange(len(a))
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(a) - 1):
            p, q = seats[:len(a) // 2], seats[len(a) // 2:][::-1]
            x, y = a[p], a[q]
            xx, yy, xy = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            size = np.sqrt(xx * yy)
            cosine = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            turn = cosine > ORTHOGONAL
            worst = max(worst, cosine.max(initial=0.0))
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            tangent = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, tangent)
            s = c * tangent
            a[p], a[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
        if worst <= ORTHOGONAL * len(a):
            break
    return a[:factor.shape[1]].T


@dataclass
class Whitening:
    """n distinct vectors with sums S, unit components by falling eigenvalue (rows), and the covariance's trace."""
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Centred vectors on the components, each over the root of its eigenvalue."""
        return deviations(x, self.n, self.sums).astype(np.float64) / self.n @ self.components.T / np.sqrt(
            self.eigenvalues)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in longs where they suffice for its squares' sum too, otherwise in Python's integers."""
    reach = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    if reach * reach * max(1, x.shape[1]) <= LONGEST:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def learn(rows: DataFrame, components: int = COMPONENTS, name: str = "x") -> Whitening | None:
    """The whitening of the distinct vectors among ``rows`` (from ``whole``); None without any.

    Vectors that are not as long as the commonest length (the smaller of tied ones) don't count. Components without
    variance are left out. Rows move once, to find the distinct ones.
    """
    x = F.col(f"`{name}`")
    sizes = rows.groupBy(F.size(x).alias("wide")).count().orderBy(F.desc("count"), "wide").first()
    if sizes is None:
        return None
    wide = sizes["wide"]
    distinct = common.settle(rows.where(F.size(x) == wide).select(x.alias("x")).distinct())
    totals = (distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i")
              .agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("i").collect())
    n, sums = totals[0]["n"], [int(r["s"]) for r in totals]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    parts = distinct.mapInArrow(_product_batches(centre), "i int, j int, s string")
    summed = parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    covariance = np.zeros((wide, wide))
    shift = [s - n * m for s, m in zip(sums, centre)]
    for i, j, s in summed:
        covariance[i, j] = covariance[j, i] = float(Fraction(n * int(s) - shift[i] * shift[j], n * n))
    rotated = one_sided_jacobi(pivoted_cholesky(covariance))
    values = (rotated * rotated).sum(axis=0)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > 0]
    units = (rotated[:, order] / np.sqrt(values[order])).T
    largest = np.abs(units).argmax(axis=1) if len(units) else np.zeros(0, int)
    units = units * np.sign(units[np.arange(len(units)), largest])[:, None]
    found = Whitening(n, sums, units, values[order], float(np.trace(covariance)), 0.0)
    found.identity_error = _identity_error(distinct, found)
    return found


def _identity_error(distinct: DataFrame, fitted: Whitening) -> float:
    """Largest entry by which the whitened fit list's covariance differs from the identity."""
    k = len(fitted.components)
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            w = fitted.project(matrix(batch.column(0), len(fitted.sums)))
            total[:, :k] += w.T @ w
            total[:, k] += w.sum(axis=0)
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()),
                                          pa.array(total.reshape(-1))], names=["i", "j", "s"])

    sums = np.zeros((k, k + 1))
    for i, j, s in distinct.mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(
            F.sum("s").alias("s")).collect():
        sums[i, j] = s
    mean = sums[:, k] / fitted.n
    return float(np.abs(sums[:, :k] / fitted.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, fitted: Whitening, id_col: str = "vec_id", name: str = "x") -> DataFrame:
    """Each row on each component: id, component, n, deviation, whitened, explained and identity_error.

    Repeated and null ids are rows like any other. Rows of another length than the fitted ones are left out. A
    deviation beyond a long is null.
    """
    k, wide = len(fitted.components), len(fitted.sums)
    shares = fitted.eigenvalues / fitted.trace if k else np.zeros(0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), wide)
            apart = deviations(x, fitted.n, fitted.sums)
            squares = [int(s) if s <= LONGEST else None for s in (apart * apart).sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(squares, pa.int64()),
                 pa.array(list(fitted.project(x)), pa.list_(pa.float64()))], names=["id", "deviation", "w"])

    plain = rows.where(F.size(F.col(f"`{name}`")) == wide).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{name}`").alias("x"))
    schema = T.StructType([*plain.select("id").schema, T.StructField("deviation", T.LongType()),
                           T.StructField("w", T.ArrayType(T.DoubleType()))])
    out = plain.mapInArrow(place, schema).select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(float(s)) for s in shares]).cast("array<double>"), F.col("at"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"),
        "deviation", "whitened", explained.alias("explained"),
        F.lit(fitted.identity_error).alias("identity_error"))


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             components: int = COMPONENTS) -> DataFrame:
    """All usable vectors whitened by their own distinct values; an empty table gives no rows."""
    rows = whole(vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")), "v")
    fitted = learn(rows, components)
    if fitted is None:
        fitted = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
        rows = rows.limit(0)
    return whiten(rows, fitted, "id").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(common.read(spark, sf_dir, "embeddings"))
