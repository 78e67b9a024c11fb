"""Nearest neighbours by inner product from a permutation index.

A bounded sample of vectors are pivots. Every vector is represented by the order of its nearest pivots and posted
in the inverted files of the first few. A query visits the files of its own nearest pivots; in a file, postings
are ranked by the footrule distance between the two orders, and the closer half is reranked by the inner product
of the original vectors in double precision.

Directions alone miss long vectors, whose inner products are large. Where lengths differ, there is a second index
beside the first: a vector v gets one more component, sqrt(M^2 - |v|^2) with M the largest length, and a query gets
0, so that the angle between the two falls as their inner product grows. A query visits its files in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm import common

#: Pivots (vectors of the smallest id hashes), length of the stored order, files a vector is posted in, files a
#: query visits, share of a file that is reranked and the least number of postings that are.
PIVOTS = 256
ORDER = 32
POSTED = 8
VISITED = 32
RERANKED = 0.5
LEAST = 256
#: Most postings and queries that meet in one group; larger files are split on both sides.
POSTINGS = 8192
QUERIES = 2048
NEAREST = 20
EVERY = 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: an id, and finite components that are not all zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where("id IS NOT NULL AND v IS NOT NULL").where(F.coalesce(finite, F.lit(False)))
            .where(F.exists(v, lambda x: x != 0)))


def height(vectors: np.ndarray, longest: float) -> np.ndarray:
    """sqrt(longest^2 - |v|^2) of each vector."""
    lengths = np.linalg.norm(vectors, axis=1)
    return np.sqrt(np.maximum(longest - lengths, 0.0)) * np.sqrt(longest + lengths)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """Distinct vectors among the ``4 * pivots`` of the smallest id hashes, in their own lengths."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(4 * pivots).collect()
    found = list(dict.fromkeys(tuple(r["v"]) for r in sample))[:pivots]
    return np.array(found, np.float64) if found else np.zeros((0, 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def ordered(rows: DataFrame, pivots: np.ndarray, longest: float | None, queries: bool = False) -> DataFrame:
    """Adds ``base`` and ``order``: the numbers of the nearest pivots, nearest first; ties go to the smaller number.

    base 0 is by direction. Unless ``longest`` is None, each row comes once more with the number of pivots as base:
    vectors and pivots raised to that length by one more component, queries with 0 there.
    """
    keep = min(ORDER, len(pivots))
    flat = unit(pivots)
    raised = None if longest is None else unit(np.column_stack([pivots, height(pivots, longest)]))

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = matrix(batch.column(1))
            products = [own @ flat.T]
            if raised is not None:
                up = np.zeros(len(own)) if queries else height(own, longest)
                products.append(np.column_stack([own, up]) @ raised.T)
            for side, near in enumerate(products):
                near = np.argsort(-near, axis=1, kind="stable")[:, :keep]
                order = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * keep),
                                                 pa.array(near.astype(np.int32).ravel()))
                base = pa.array(np.full(len(near), side * len(pivots), np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, base, order], names=["id", "v", "base", "order"])

    return rows.mapInArrow(orders, "id long, v array<double>, base int, order array<int>")


def footrules(queries: np.ndarray, postings: np.ndarray, pivots: int) -> np.ndarray:
    """Spearman's footrule between orders [q, k] and [p, k], pivots beyond an order counting as place k."""
    k = postings.shape[1]
    place = np.full((len(queries), pivots), k, np.int16)
    np.put_along_axis(place, queries, np.arange(k, dtype=np.int16)[None, :], axis=1)
    # What the query's own pivots add if the posting has none of them, corrected for each that it has.
    out = np.full((len(queries), len(postings)), k * (k + 1) // 2, np.int16)
    for r in range(k):
        out += np.take(np.abs(place - r) - (k - place), postings[:, r], axis=1)
    return out


def rerank(postings: pa.Table, queries: pa.Table, pivots: int, nearest: int, block: int = 256) -> pa.Table:
    """Best ``nearest`` postings of a file for each query: inner products in double, ties to the smaller id."""
    names = ["query_id", "vec_id", "score"]
    ids = postings.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    whole = lambda t, c: matrix(t.column(c).combine_chunks())
    if not len(ids) or not queries.num_rows:
        return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()))})
    vectors, orders = whole(postings, "v")[order], whole(postings, "order")[order]
    asked, vs, os = queries.column("id").to_numpy(), whole(queries, "v"), whole(queries, "order")
    closer = max(LEAST, int(np.ceil(RERANKED * len(ids))))
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(asked), block):
        own = asked[at:at + block]
        scores = vs[at:at + block] @ vectors.T
        if closer < len(ids):
            far = footrules(os[at:at + block], orders, pivots)
            limit = np.partition(far, closer - 1, axis=1)[:, closer - 1:closer]
            scores[far > limit] = -np.inf
        scores[own[:, None] == ids[None, :]] = -np.inf
        take = min(nearest, len(ids))
        floor = np.partition(scores, len(ids) - take, axis=1)[:, len(ids) - take]
        # The product of whole blocks may differ in the last bits between equal vectors; those near the
        # boundary are all taken and scored again one by one.
        row, col = np.nonzero((scores >= (floor - 1e-9 * (1 + np.abs(floor)))[:, None]) & np.isfinite(scores))
        exact = (vs[at + row] * vectors[col]).sum(axis=1)
        best = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[best], col[best], exact[best]
        nth = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        good = nth < nearest
        out.append((own[row[good]], ids[col[good]], exact[good]))
    return pa.table(dict(zip(names, map(np.concatenate, zip(*out)))))


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           nearest: int = NEAREST, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of ``vectors`` found for each row of ``queries``.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor rows without an id. A
    row is never its own neighbour. Rows with equal ids count once, with their best score. Fewer candidates than
    ``nearest`` are all returned; empty tables give no rows. Vectors are of one length.
    """
    rows = usable(vectors, id_col, vector_col)
    chosen = choose_pivots(rows, pivots)
    schema = "query_id long, vec_id long, score double"
    if not len(chosen):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    shortest, longest = rows.agg(F.min(length), F.max(length)).first()
    # Vectors of one length have the same orders in both indexes.
    longest = longest if longest - shortest > 1e-6 * longest else None
    indexed = common.settle(ordered(rows, chosen, longest))
    asking = common.settle(ordered(usable(queries, id_col, vector_col), chosen, longest, queries=True))
    file = lambda df, n: df.withColumn("pivot", F.explode(F.slice("order", 1, n))).withColumn(
        "pivot", F.col("pivot") + F.col("base"))
    # One row for each pivot: how many parts its file and its queries are dealt to.
    parts = lambda df, n, most, name: file(df.select("base", "order"), n).groupBy("pivot").agg(
        F.ceil(F.count("*") / most).alias(name))
    deal = common.settle(parts(indexed, POSTED, POSTINGS, "ps").join(parts(asking, VISITED, QUERIES, "qs"), "pivot"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = (file(indexed, POSTED).join(F.broadcast(deal), "pivot")
            .withColumn("p", part("ps")).withColumn("q", every("qs")))
    right = (file(asking, VISITED).join(F.broadcast(deal), "pivot")
             .withColumn("q", part("qs")).withColumn("p", every("ps")))
    count = len(chosen)
    columns, keys = ["id", "v", "order", "pivot", "p", "q"], ["pivot", "p", "q"]
    found = (left.select(columns).groupBy(*keys).cogroup(right.select(columns).groupBy(*keys))
             .applyInArrow(lambda a, b: rerank(a, b, count, nearest), schema))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= nearest).select(
        "query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
