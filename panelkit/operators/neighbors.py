"""Exact k nearest neighbours (Euclidean).

A reference side whose measured size fits ``broadcast_bytes`` is broadcast and searched in
blocks. A larger one is partitioned around pivots: bounds from the triangle inequality decide
which reference rows any query of a cell could need, cells and their reference rows are cut into
chunks of bounded size, and each chunk pair reports its k best. No pair is ever emitted beyond
those, and no candidate is dropped that could be among the k nearest.

Ties go to the smaller id; distances are compared after rounding to ``DECIMALS``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators import ranking

DECIMALS = 9
BROADCAST_BYTES = 64 * 1024 * 1024
CHUNK_ROWS = 50_000
BLOCK = 512
REFERENCES = 4096  # reference rows compared at once: 8 MiB of bounds
TASK_PAIRS = 1 << 28  # pairs of a task, about: a second or two
OUT = "q_id {t}, n_id {t}, dist double"


def _distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    total = np.zeros((len(q), len(r)))
    for j in range(q.shape[1]):
        diff = q[:, j, None] - r[None, :, j]
        total += diff * diff
    return np.round(np.sqrt(total), DECIMALS)


def _best(ids, rows, cols, dist, k):
    """The first k of each query row by distance, then column."""
    order = np.lexsort((cols, dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    first = np.searchsorted(rows, np.arange(len(ids)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], cols[keep], dist[keep]


def _pair_distances(q: np.ndarray, r: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """``_distances`` of single pairs, added up in the same order."""
    total = np.zeros(len(rows))
    for j in range(q.shape[1]):
        diff = q[rows, j] - r[cols, j]
        total += diff * diff
    return np.round(np.sqrt(total), DECIMALS)


def _nearest(q_ids, q, r_ids, r, k, exclude_self):
    """Best k of ``r`` (sorted by id, so that columns order ties) for each row of ``q``, in blocks of both.

    One matrix product for each pair of blocks bounds all squared distances from below, in single precision and with
    its largest rounding error taken off. Only what may come under a row's k-th distance so far is computed as such.
    """
    r_ok, q_ok = np.isfinite(r).all(axis=1), np.isfinite(q).all(axis=1)
    q_ids, q, r_ids, r = q_ids[q_ok], q[q_ok], r_ids[r_ok], r[r_ok]
    if not len(q) or not len(r):
        return
    with np.errstate(over="ignore", invalid="ignore"):
        # Below 1, so that nothing overflows.
        unit = max(np.abs(q).max(initial=0.0), np.abs(r).max(initial=0.0)) or 1.0
        error = 16 * (q.shape[1] + 8) * float(np.finfo(np.float32).eps)
        small = lambda x: (x / unit).astype(np.float32)
        norm = lambda x: ((x / unit) ** 2).sum(axis=1)
        right = np.ascontiguousarray(np.column_stack([small(r), ((1 - error) * norm(r)).astype(np.float32)]).T)
        for start in range(0, len(q), BLOCK):
            ids, own = q_ids[start:start + BLOCK], q[start:start + BLOCK]
            left = np.column_stack([-2 * small(own), np.ones(len(own), np.float32)])
            far = (1 - error) * norm(own)
            kth = np.full(len(own), np.inf)
            best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for at in range(0, len(r), REFERENCES):
                low = left @ right[:, at:at + REFERENCES]
                if not at:
                    # A first limit: the k-th least bound, and what it may lie below the distance.
                    sure = low.copy()
                    if exclude_self:
                        sure[ids[:, None] == r_ids[None, :REFERENCES]] = np.inf
                    kk = min(k, sure.shape[1])
                    most = np.partition(sure, kk - 1, axis=1)[:, kk - 1] if kk == k else np.full(len(own), np.inf)
                    most = most + far + 4 * error * (far + norm(r[:REFERENCES]).max()) + 1e-30
                    near = np.sqrt(np.maximum(most, 0.0))
                else:
                    near = kth / unit
                # Distances are compared rounded. Ids rise, so a later row has to be nearer; nothing is nearer than 0.
                limit = (near + 10.0 ** -DECIMALS / unit) ** 2 * (1 + error) - far + 1e-30
                limit = np.where(kth > 0, limit, -np.inf)
                limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
                rows, cols = np.nonzero(~(low > limit[:, None]))
                if exclude_self:
                    other = ids[rows] != r_ids[cols + at]
                    rows, cols = rows[other], cols[other]
                if not len(rows):
                    continue
                dist = _pair_distances(own, r, rows, cols + at)
                keep = np.isfinite(dist) & (dist <= kth[rows])
                found = rows[keep], cols[keep] + at, dist[keep]
                best = _best(ids, *map(np.concatenate, zip(best, found)), k)
                full = np.bincount(best[0], minlength=len(ids)) >= k
                last = np.flatnonzero(np.append(best[0][1:] != best[0][:-1], True)) if len(best[0]) else []
                kth[best[0][last]] = best[2][last]
                kth[~full] = np.inf
            rows, cols, dist = best
            yield pd.DataFrame({"q_id": ids[rows], "n_id": r_ids[cols], "dist": dist})


def _matrix(pdf: pd.DataFrame, vec: str) -> np.ndarray:
    return np.stack(pdf[vec].to_numpy()).astype("float64")


def _spread(df: DataFrame, pairs: int, *keys: str) -> DataFrame:
    """``df`` dealt out by the pairs to compare, since its bytes don't tell the work."""
    most = 8 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(most, -(-pairs // TASK_PAIRS)), *keys) if pairs > TASK_PAIRS else df


def _by_broadcast(queries, refs, k, exclude_self, id_type) -> DataFrame:
    local = refs.toPandas().sort_values("id", kind="stable")
    sent = refs.sparkSession.sparkContext.broadcast(
        (local["id"].to_numpy(), _matrix(local, "vec") if len(local) else np.zeros((0, 1))))

    def search(batches):
        r_ids, r = sent.value
        for pdf in batches:
            if len(pdf) and len(r):
                yield from _nearest(pdf["id"].to_numpy(), _matrix(pdf, "vec"), r_ids, r, k, exclude_self)

    return _spread(queries, queries.count() * len(local)).mapInPandas(search, OUT.format(t=id_type))


def _assign(df: DataFrame, pivots: np.ndarray, id_type: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(pivots)

    def nearest_pivot(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(_matrix(pdf, "vec"), sent.value)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), near=d[np.arange(len(d)), cell])

    return df.mapInPandas(nearest_pivot, f"id {id_type}, vec array<double>, cell int, near double")


def _by_cells(queries, refs, k, exclude_self, id_type, cells, chunk_rows) -> DataFrame:
    spark = refs.sparkSession
    need = k + 1 if exclude_self else k
    pivots = _matrix(ranking.take_exact(refs, cells, "id", "pivots").orderBy("id").toPandas(), "vec")
    q, r = _assign(queries, pivots, id_type), _assign(refs, pivots, id_type)

    # Per cell: how far its queries reach, and its few reference rows next to the pivot.
    reach = {x["cell"]: x["far"] for x in q.groupBy("cell").agg(F.max("near").alias("far")).collect()}
    closest = Window.partitionBy("cell").orderBy("near", "id")
    kept = r.select("cell", "near", "id").withColumn("i", F.row_number().over(closest)).filter(
        F.col("i") <= need).select("cell", "near").collect()
    gap = _distances(pivots, pivots)
    slack = 10.0 ** (1 - DECIMALS)
    routes = []
    for i, far in reach.items():
        bounds = sorted(gap[i][x["cell"]] + x["near"] for x in kept)
        bound = far + bounds[need - 1] if len(bounds) >= need else float("inf")
        for j in range(len(pivots)):
            routes.append((i, j, float(gap[i][j] - far - bound - slack),
                           float(gap[i][j] + far + bound + slack)))
    # One row per pair of cells: bounded by the square of the pivot count, not by the data.
    route = spark.createDataFrame(routes, "q_cell int, cell int, lo double, hi double")
    routed = r.join(F.broadcast(route), "cell").filter("near between lo and hi").select(
        "q_cell", "id", "vec")
    sizes = (routed.groupBy("q_cell").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("n_r"))
             .join(q.groupBy(F.col("cell").alias("q_cell")).agg(
                 F.ceil(F.count(F.lit(1)) / chunk_rows).alias("n_q")), "q_cell"))
    sizes = sizes.collect()
    pairs = sum(x["n_r"] * x["n_q"] for x in sizes) * chunk_rows * chunk_rows
    sizes = F.broadcast(spark.createDataFrame(sizes, "q_cell int, n_r bigint, n_q bigint"))

    def chunk(n):
        return F.pmod(F.xxhash64("id"), F.col(n))

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    key = ["q_cell", "q_part", "r_part"]
    left = q.withColumnRenamed("cell", "q_cell").join(sizes, "q_cell").select(
        "q_cell", chunk("n_q").alias("q_part"), every("n_r").alias("r_part"), "id", "vec")
    right = routed.join(sizes, "q_cell").select(
        "q_cell", every("n_q").alias("q_part"), chunk("n_r").alias("r_part"), "id", "vec")

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q_id": [], "n_id": [], "dist": []})
        b = b.sort_values("id", kind="stable")
        return pd.concat(_nearest(a["id"].to_numpy(), _matrix(a, "vec"), b["id"].to_numpy(),
                                  _matrix(b, "vec"), k, exclude_self))

    left, right = (_spread(side, pairs, *key) for side in (left, right))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(pair, OUT.format(t=id_type))


def knn(queries: DataFrame, refs: DataFrame, k: int, id_col: str, vec_col: str,
        exclude_self: bool = False, broadcast_bytes: int = BROADCAST_BYTES,
        chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(q_id, rank, n_id, dist)``: each query's k nearest reference rows, all of them exact."""
    id_type = dict(refs.select(id_col).dtypes)[id_col]
    if dict(queries.select(id_col).dtypes)[id_col] != id_type:
        id_type = "string"
    def shape(df):
        return df.select(F.col(id_col).cast(id_type).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    queries, refs = shape(queries), shape(refs)
    size = refs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    volume = size["n"] * (size["d"] or 0) * 8
    if volume <= broadcast_bytes:
        found = _by_broadcast(queries, refs, k, exclude_self, id_type)
    else:
        cells = int(min(256, max(4, volume // broadcast_bytes)))
        found = _by_cells(queries, refs, k, exclude_self, id_type, cells, chunk_rows)
    best = Window.partitionBy("q_id").orderBy("dist", "n_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "q_id", "rank", "n_id", "dist")
