import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelkit.llm import common, quality


def brute_marginals(field, unary):
    total, good = 0.0, np.zeros(len(unary))
    for path in itertools.product((0, 1), repeat=len(unary)):
        s = field.start[path[0]] + sum(unary[i, y] for i, y in enumerate(path))
        s += sum(field.transitions[a, b] for a, b in zip(path, path[1:]))
        total += np.exp(s)
        good += np.exp(s) * np.array(path)
    return good / total


def test_forward_backward_against_all_paths():
    draw = np.random.default_rng(0)
    counts = np.array([3, 1, 6, 2, 1, 5])
    field = quality.Field(np.zeros(1), np.ones(1), np.zeros(2), draw.normal(size=(2, 2)), draw.normal(size=2))
    unary = np.column_stack([np.zeros(counts.sum()), draw.normal(0, 2, counts.sum())])
    got = np.exp(field.marginals(counts, unary)[0][:, 1])
    want = np.concatenate([brute_marginals(field, u) for u in np.split(unary, np.cumsum(counts)[:-1])])
    assert np.allclose(got, want)


def test_features_by_hand():
    texts = ["", "\n", "AB cd cd\n\n12 !!|", "x\n", "é ### é"]
    counts, x, length = quality.features(*common.flat_bytes(pa.array(texts)))
    assert counts.tolist() == [1, 2, 3, 2, 1] and length.tolist() == [0, 0, 0, 8, 0, 6, 1, 0, 9]
    line = x[3]
    assert np.allclose(line[:9], np.array([4, 2, 0, 3, 0, 0, 0, 0, 0]) / 9)
    assert np.isclose(line[12], 1 / 3) and np.isclose(line[10], 2 / 10)
    last = x[5]
    assert np.allclose(last[[quality.DIGIT, quality.BANG, quality.BAR]], np.array([2, 2, 1]) / 6)
    # Neighbours: the last line of the third text sees the empty line before it and nothing after.
    assert np.allclose(last[13:], 0) and np.allclose(x[4][13:19], line[quality.ODD + [12]])


def test_scores_do_not_depend_on_the_batch():
    texts = ["one line", "", "UP! UP!\nlow low\n| | |", "a\n" * 300, "é"] * 3
    field = quality.fit(*_sample(texts, [1, 1, 0, 1, 0] * 3))
    whole = field.scores(*quality.features(*common.flat_bytes(pa.array(texts))))
    each = [field.scores(*quality.features(*common.flat_bytes(pa.array([t]))))[0] for t in texts]
    assert np.allclose(whole, each) and ((whole >= 0) & (whole <= 1)).all()


def _sample(texts, labels):
    counts, x, _ = quality.features(*common.flat_bytes(pa.array(texts)))
    return counts, x, np.array(labels)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in quality.query(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == 10_000
    held = [(r.quality, got[r.doc_id]) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(g.held_out for _, g in held) and len(held) > 500
    assert np.mean([q == g.predicted for q, g in held]) > 0.98
    assert np.mean([g.predicted for q, g in held if q == 1]) > 0.99


def test_odd_rows_and_no_labels(spark, odd_docs):
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    field = quality.learn(odd_docs, none)
    got = quality.with_score(odd_docs, field, name="mk_q")
    assert got.columns == [*odd_docs.columns, "mk_q"] and got.count() == odd_docs.count()
    assert np.allclose([r.mk_q for r in got.collect()], 0.5)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(19)] + [(5, 0, 1)], "doc_id long, quality int, toxic int")
    again = quality.with_score(odd_docs, quality.learn(odd_docs, labels)).collect()
    assert len(again) == odd_docs.count() and all(0 <= r[-1] <= 1 for r in again)
    assert quality.with_score(odd_docs.limit(0), field).count() == 0


@pytest.mark.parametrize("limit", [1, 10, 1000])
def test_slices_cover_all_rows(texts, limit):
    column = pa.array(texts)
    found = list(common.slices(column, limit))
    assert [i for a, b in found for i in range(a, b)] == list(range(len(texts)))
