import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.llm import mixing


def naive_seats(votes, seats):
    given = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * given[i] + 1), -i))
        given[best] += 1
    return given


@pytest.mark.parametrize("seed", range(6))
def test_seats_are_those_of_the_highest_quotients(seed):
    draw = np.random.default_rng(seed)
    votes = draw.integers(0, 10 ** draw.integers(1, 6), draw.integers(1, 30)).astype(float)
    for seats in (0, 1, 7, 100, 1001):
        want = naive_seats(votes, seats) if votes.sum() else [0] * len(votes)
        assert mixing.sainte_lague(votes, seats).tolist() == want


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in stopped)
        level = left / max(1e-9, sum(weight[s] for s in names if s not in stopped))
        over = {s for s in names if s not in stopped and weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in stopped else weight[s] * level for s in names}
        stopped |= over


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, taken int, n_chars long")


def rows_of(sources):
    out, n = [], 0
    for source, sizes in sources.items():
        for size in sizes:
            out.append((n, " ".join(f"w{n}_{i}" for i in range(size)), source, "x", 5, size))
            n += 1
    return out


CASES = {"even": {"a": [100] * 20, "b": [50] * 40, "c": [7] * 200, "é": [33] * 30, None: [60] * 10},
         "hot": {"a": [300] * 200, "b": [1] * 9, "B": [40] * 3, "": [5], None: [0, 0]},
         "bare": {"a": [0, 0], None: [0]}, "one": {"x": [2000]}}


@pytest.mark.parametrize("name", CASES)
def test_mix_meets_targets(spark, name):
    docs = table(spark, rows_of(CASES[name]))
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.mix(sized, shard_words=4000).toPandas()
    again = mixing.mix(sized.repartition(3), shard_words=4000).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    pd.testing.assert_frame_equal(got[key].sort_values(key, ignore_index=True), again[key].sort_values(key, ignore_index=True))
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    want = brute_targets({s: sum(v) for s, v in CASES[name].items()})
    shards = max(1, -(-sum(map(sum, CASES[name].values())) // 4000))
    for source, rows in got.groupby(got.source.fillna("<null>")):
        source = None if source == "<null>" else source
        assert np.allclose(rows.target, want[source])
        assert abs(rows.taken.sum() - want[source]) <= mixing.BLOCK * shards * (1 + len(CASES[name]) / 2)


def test_mixed_documents_hold_the_words_taken(spark):
    rows = rows_of(CASES["even"])
    rows += [rows[3], rows[3], (None, "null id words here", None, "x", 1, 3), (None, None, "a", None, None, None),
             (999, "", "a", None, None, 0)]
    docs = table(spark, rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.toPandas()
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = mixing.mix(sized).toPandas()
    assert got.text.str.split().str.len().sum() == plan.taken.sum()
    per = got.assign(n=got.text.str.split().str.len()).groupby("doc_id").n.sum()
    want = plan[plan.taken > 0].groupby("doc_id").taken.sum()
    assert per.to_dict() == want.to_dict()
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    own: dict = {}
    for r in rows:
        own.setdefault(r[0], set()).update((r[1] or "").split())
    assert all(set(r.text.split()) <= own[None if pd.isna(r.doc_id) else int(r.doc_id)] for r in got.itertuples())


def test_clashing_names_come_back(spark):
    docs = table(spark, rows_of({"a": [40] * 5, "b": [9] * 30})).withColumns(
        {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("row", "nth", "copy", "rounds", "mk_row", "id")})
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 10
    for c in ("row", "nth", "copy", "rounds", "mk_row", "id"):
        assert mixed.where(F.col(c) != F.concat(F.lit(c), F.col("doc_id").cast("string"))).count() == 0
