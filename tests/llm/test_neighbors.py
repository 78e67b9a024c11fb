import numpy as np
import pytest

from panelkit.llm import neighbors


def brute(rows, asked, nearest=20):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], np.float64)
    out = {}
    for q in asked:
        scores = (vectors * vectors[ids == q][0]).sum(axis=1)
        keep = ids != q
        order = np.lexsort((ids[keep], -scores[keep]))[:nearest]
        out[q] = list(zip(ids[keep][order].tolist(), scores[keep][order].tolist()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                                 "vec_id long, embedding array<float>, pivot string, score int")


def test_footrule_by_hand():
    q, p = np.array([[3, 1, 0]]), np.array([[3, 1, 0], [0, 1, 3], [4, 5, 2], [1, 3, 6]])
    place = lambda order: {x: order.index(x) if x in order else 3 for x in range(7)}
    want = [sum(abs(place(q[0].tolist())[x] - place(r.tolist())[x]) for x in range(7)) for r in p]
    assert neighbors.footrules(q, p, 7)[0].tolist() == want


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0])
    got = {}
    for r in neighbors.query(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    recall = np.mean([len({v for _, v, _ in got[q]} & {v for v, _ in w}) / 20 for q, w in want.items()])
    assert recall >= 0.9
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert np.allclose([s for _, _, s in found], [vectors[q] @ vectors[v] for _, v, _ in found], atol=1e-12)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))


@pytest.mark.parametrize("most", [8192, 40])
def test_ties_copies_and_split_files(spark, most, monkeypatch):
    monkeypatch.setattr(neighbors, "POSTINGS", most)
    monkeypatch.setattr(neighbors, "QUERIES", 3)
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(100)]
    rows += [(i, rows[7][1]) for i in range(100, 200)]
    df = frame(spark, rows)
    want = brute(rows, range(0, 200, 20))
    got = {}
    for r in neighbors.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = [len(set(got[q]) & {v for v, _ in w}) / 20 for q, w in want.items()]
    assert np.mean(hits) >= 0.95
    # All nearest of a copied vector are copies, the smallest ids first.
    assert got[120] == [7, *range(100, 119)]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None),
            (6, [1.0, None]), (40, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.5])]
    df = frame(spark, rows)
    got = neighbors.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [
        (0, 1, 3, 1.0), (0, 2, 20, 0.0), (0, 3, 9, -1.0), (20, 1, 3, 2.0), (20, 2, 9, 1.0), (20, 3, 0, 0.0)]
    assert neighbors.search(df.limit(0), df).count() == 0 and neighbors.search(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0.5, 1.0])
def test_recall_with_varied_lengths_and_a_hot_cluster(spark, spread):
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(6000, 64))
    vectors[::3] = draw.normal(size=64) + 0.5 * vectors[::3]
    vectors *= np.exp(spread * draw.normal(size=(6000, 1))) / np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, v) for i, v in enumerate(vectors.astype(np.float32).tolist())]
    df = frame(spark, rows)
    want = brute(rows, range(0, 6000, 100))
    got = {}
    for r in neighbors.search(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {v for v, _ in w}) / 20 for q, w in want.items()]) >= 0.95
