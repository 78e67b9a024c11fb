import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from panelkit.llm import audit

GOOD = " ".join(f"word{i}" for i in range(60))


def failing(text, later):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = [len(words) < 50, 100 * len(set(words)) < 65 * len(words),
             100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), later]
    return {f for f, t in zip("ABCDE", tests) if t}


def brute(rows, labels):
    """rows (doc_id, text, source), labels (doc_id, quality, toxic): each order applied filter by filter."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    smallest = {}
    for d, t, _ in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    docs = [(s or "", failing(t, d is not None and d > smallest[t or ""]), d) for d, t, s in rows]
    out, values = {}, defaultdict(int)
    for part in {s for s, _, _ in docs}:
        own = [(f, d) for s, f, d in docs if s == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                values[part, f] += len(gone)
                out[part, order, step] = (
                    len(left), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == {f} for x in own),
                    sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone))
    return {k: (*v, values[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def told(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost,
                                               r.toxic_lost, r.shapley) for r in df.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(0, 1, 0), (0, 0, 1), (3, None, None), (5, 1, 1), (6, 1, 0), (7, 0, 1), (100, 1, 0), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_against_every_order(spark, odd_docs, labels):
    more = [(100, GOOD), (101, GOOD), (101, GOOD), (102, GOOD + " #"), (99, GOOD.upper()), (None, GOOD), (None, GOOD)]
    extra = spark.createDataFrame([(i, t, "en", s, 0, "x", 1, "y") for i, t in more for s in ("s", "t")],
                                  odd_docs.schema)
    docs = odd_docs.union(extra).withColumnsRenamed({"score": "mask", "bucket": "print", "mk_id": "part"}).repartition(3)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert told(audit.audit(docs, labels)) == brute(rows, [tuple(r) for r in labels.collect()])


def test_masks_count_every_row(odd_docs, labels):
    found = audit.masks(odd_docs, labels)
    assert found.agg(F.sum("docs")).first()[0] == odd_docs.count()
    assert found.count() == found.select("part", "mask").distinct().count()


def test_shapley_shares_add_up(spark):
    rows = told(audit.query(spark, "/root/testdata/sf0.001"))
    for part in {p for p, _, _ in rows}:
        gone = sum(rows[part, "ABCDE", s][1] for s in range(1, 6))
        assert sum(rows[part, "ABCDE", s][6] for s in range(1, 6)) == audit.ORDERS * gone


def test_empty_tables(odd_docs, labels):
    assert audit.audit(odd_docs.limit(0), labels).count() == 0
    rows = told(audit.audit(odd_docs, labels.limit(0)))
    assert len(rows) == 600 * 2 and not any(v[4] or v[5] for v in rows.values())
