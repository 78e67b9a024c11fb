import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, id string, n long"


def brute(rows, k=4):
    """rows (id, vector): n, sums and eigen decomposition in numpy's own way."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, sums = len(fit), [sum(c) for c in zip(*{tuple(x) for _, x in kept})]
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    out = []
    for i, x in kept:
        w = (np.array(x) - np.array(sums) / n) @ vectors[:, order] / np.sqrt(values[order])
        out.append((i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), w))
    return n, out, values[order] / values.sum()


def agrees(found, rows, k=4):
    n, want, shares = brute(rows, k)
    got = found.orderBy("component", "vec_id", "deviation").collect()
    assert len(got) == k * len(want) and {r.n for r in got} <= {n}
    w = np.array([r.whitened for r in got]).reshape(k, -1).T
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.component, r.vec_id, r.deviation) for r in got] == [(c + 1, i, d) for c in range(k) for i, d, _ in want]
    truth = np.array([r[2] for r in want])
    truth = truth * np.sign((truth * w).sum(axis=0))
    assert np.abs(w - truth).max() < 1e-6
    assert np.allclose([r.explained for r in got[::len(want)]], shares, rtol=1e-8)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(150, 7)) * np.array([3, 2, 1, 0.5, 0.2, 0.1, 0.05]) + 5
    rows = [(i, [float(np.float32(c)) for c in v], 1, "x", None, 2) for i, v in enumerate(base)]
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, None, None), (3, rows[5][1], 1, None, "q", 1),
             (900, None, 1, "y", "z", 3), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0], 0, None, None, None),
             (902, [float("nan")] * 7, 0, None, None, None), (903, [float("-inf")] + [0.0] * 6, 0, None, None, None),
             (904, [-0.0] * 7, 0, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_against_eigh(vectors):
    agrees(whitening.whitened(vectors), [(r.vec_id, r.embedding) for r in vectors.collect()])


def test_query_on_a_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    agrees(whitening.query(spark, "/root/testdata/sf0.01"), [(r.vec_id, r.embedding) for r in rows])


def test_hot_copies_count_once(spark, vectors):
    row = vectors.where("vec_id = 7").limit(1)
    copies = row.crossJoin(spark.range(500).select(F.col("id").alias("nth"))).drop("nth")
    once, often = (whitening.learn(whitening.whole(v.select("vec_id", "embedding"))) for v in (vectors, vectors.union(copies)))
    assert once.n == often.n and once.sums == often.sums and (once.components == often.components).all()


def test_large_entries_and_partitions_change_nothing(spark):
    draw = np.random.default_rng(5)
    big = draw.integers(-2**40, 2**40, (60, 3))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(big)], "vec_id long, embedding array<double>")
    a, b = (whitening.learn(whitening.whole(rows.repartition(p))) for p in (1, 5))
    assert (a.components == b.components).all() and (a.eigenvalues == b.eigenvalues).all()
    centred = 256.0 * (big - big.mean(axis=0))
    assert np.allclose(a.eigenvalues, np.linalg.eigvalsh(centred.T @ centred / 60)[::-1], rtol=1e-12)
    assert all(r.deviation is None for r in whitening.whitened(rows).collect())


def test_ranks(spark):
    for rows, k in (([[1.0, 2.0]], 0), ([[1.0, 2.0], [3.0, 2.0]], 1), ([[1.0, 1.0], [2.0, 2.0], [5.0, 5.0]], 1),
                    ([[1.0], [2.0], []], 1), ([], 0), ([None, []], 0)):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
        got = whitening.whitened(df)
        assert got.columns == "vec_id component n deviation whitened explained identity_error".split()
        assert {r.component for r in got.collect()} == set(range(1, k + 1))


def test_factors():
    draw = np.random.default_rng(1)
    for n, rank in ((1, 1), (5, 5), (6, 3), (9, 9)):
        a = draw.normal(size=(n, rank)) * 3.0 ** -np.arange(rank)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v)
        rotated = whitening.one_sided_jacobi(factor)
        gram = rotated.T @ rotated
        size = np.sqrt(np.diag(gram))
        assert np.abs(gram / np.outer(size, size) - np.eye(rank)).max() < 1e-14
        assert np.allclose(np.sort(np.diag(gram)), np.sort(np.linalg.svd(a)[1] ** 2), rtol=1e-9)
