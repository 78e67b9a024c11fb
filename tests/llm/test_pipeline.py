from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelkit.llm import common, mixing, pieces, quality
from tests.llm.test_minhash import jaccard, shingles
from tests.llm.test_secrets import brute as secrets_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    found = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], SF).write.parquet(f"{folder}/{i}")
        found.append(spark.read.parquet(f"{folder}/{i}"))
    return found


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])
    assert stages[-1].columns == [*stages[0].columns, "ids", "decoded", "round_trip"]


def test_quality_stage(spark, stages):
    kept = {r.doc_id: r for r in stages[1].collect()}
    score = {r.doc_id: r.predicted for r in quality.query(spark, SF).collect()}
    assert set(kept) == {d for d, p in score.items() if p == 1}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([d in kept for d, q in labels.items() if q == 1]) > 0.99
    assert np.mean([d in kept for d, q in labels.items() if q == 0]) < 0.05


def test_near_duplicate_stage(stages):
    """Jaccard similarity 0.8 on five-word shingles, against all pairs that have a shingle in common."""
    rows = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    sets, holders, root = [shingles(r.text or "") for r in rows], defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in enumerate(sets):
        for j in {j for s in own for j in holders[s]} | ({sets.index(own)} if not own else set()):
            if jaccard(own, sets[j]) >= 0.8 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
        for s in own:
            holders[s].append(i)
    assert sorted(r.doc_id for r in stages[2].collect()) == [r.doc_id for i, r in enumerate(rows) if find(i) == i]


def test_secret_stage(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    changed = 0
    for r in stages[3].collect():
        own = before[r.doc_id]
        spans = secrets_of(own.text)[4]
        assert (r.text == own.text) == (not spans)
        assert secrets_of(r.text)[:3] == (0, 0, 0)
        if spans:
            changed += 1
            assert r.n_chars == len(r.text) and "<" in r.text
        else:
            assert r == own
    assert changed


def test_mixing_and_encoding_stages(stages):
    plan = mixing.mix(stages[3].select("doc_id", "source", mixing.word_count(stages[3].text).alias("size"))).toPandas()
    mixed = stages[4].toPandas()
    words = mixed.assign(n=mixed.text.str.split(r"[\x20\x09-\x0D]+", regex=True).map(lambda w: sum(map(bool, w))))
    assert words.groupby("doc_id").n.sum().to_dict() == plan[plan.taken > 0].groupby("doc_id").taken.sum().to_dict()
    last = stages[5].collect()
    assert len(last) == len(mixed) and all(r.round_trip and r.decoded == r.text for r in last)
    with open(pieces.MODEL, "rb") as file:
        transducer = pieces.compiled(file.read())
    assert all(transducer.decode(r.ids) == r.text for r in last[:50])


def test_run_and_entry(spark):
    import __spark_entry__ as entry
    out = entry.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and "pipeline" not in entry.oracle_sql()


def test_stages_keep_clashing_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns(
        {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in (
            "mk_score", "quality_score", "mk_before", "before", "mk_row", "mk_spans", "row", "nth", "copy")})
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = common.settle(stage(spark, now, "/root/testdata/sf0.001"))
        assert now.columns == docs.columns
    for c in docs.columns[5:]:
        assert now.where(F.col(c) != F.concat(F.lit(c), F.col("doc_id").cast("string"))).count() == 0
