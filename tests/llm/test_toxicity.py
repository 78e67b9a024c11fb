import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from panelkit.llm import toxicity

UNITS = ["idiot", "id-iot", "idxiot", "loser", "closer", "straße", "aaaaaa", "abc", "worthless-clown", "zzz", "a-b-c-d",
         "x" * 24, "vequmo", "vequju"]


def brute_features(unit):
    """Every rising choice of symbols, one by one."""
    symbols, out = [0, *map(toxicity._symbol, unit)], defaultdict(float)
    for at in combinations(range(len(symbols)), toxicity.ORDER):
        own = [symbols[i] for i in at]
        if at[-1] - at[0] < toxicity.REACH and toxicity.GAP not in own:
            out[tuple(own)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
    return out


def brute_kernel(a, b):
    x, y = brute_features(a), brute_features(b)
    inner = lambda p, q: sum(v * q.get(k, 0.0) for k, v in p.items())
    size = (inner(x, x) * inner(y, y)) ** 0.5
    return inner(x, y) / size if size else 0.0


def test_kernel_against_brute_force():
    got = toxicity.Landmarks(UNITS).kernels(UNITS)
    want = np.array([[brute_kernel(a, b) for b in UNITS] for a in UNITS])
    assert np.abs(got - want).max() < 1e-6


def test_units():
    assert toxicity.units("You, I-D..iot! an i d i o t; x" + "yz" * 40) >= {"you", "i-d-iot", "idiot"}
    assert max(map(len, toxicity.units("q" * 1000 + " " + "ab" * 700))) == toxicity.LONGEST
    assert toxicity.units("") == toxicity.units(" \n\t 12 3.4 a b") == set()


def test_landmarks_span_the_candidates():
    chosen = toxicity.choose(UNITS, 6)
    assert len(set(chosen)) == 6 and not {"a-b-c-d"} & set(chosen)
    assert toxicity.choose(["same"] * 9, 4) == ["same"]


def test_machine_is_at_its_minimum():
    draw = np.random.default_rng(2)
    x = np.column_stack([draw.normal(size=(300, 5)), np.ones(300)])
    y, weight = np.where(x[:, 0] + 0.3 * draw.normal(size=300) > 0.2, 1.0, -1.0), draw.random(300)
    keep = np.array([0.1] * 5 + [0.001])
    loss = lambda w: 0.5 * (keep * w * w).sum() + 0.5 * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    w = toxicity.newton_svm(x, y, weight, ridge=0.1)
    slopes = [(loss(w + h) - loss(w - h)) / 2e-5 for h in 1e-5 * np.eye(6)]
    assert np.abs(slopes).max() < 1e-3


def planted(insults, change=lambda w, d: w, docs=240, seed=4):
    draw = random.Random(seed)
    parts = "an ber col dre el fin gor hul im jor kal lem".split()
    texts, toxic = [], []
    for i in range(docs):
        words = ["".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(draw.randint(20, 200))]
        if i % 4 == 0:
            for _ in range(draw.randint(1, 3)):
                words.insert(draw.randrange(len(words)), change(draw.choice(insults), draw))
        texts.append(" ".join(words))
        toxic.append(i % 4 == 0)
    return texts, np.array(toxic)


@pytest.fixture(scope="module")
def machine():
    texts, toxic = planted(["scumbag", "twittish", "zompfel", "zompfrex"])
    return toxicity.fit([sorted(toxicity.units(t)) for t in texts], toxic, landmarks=64)


def score(machine, texts):
    return machine.documents(machine.features([toxicity.units(t) for t in texts]))


@pytest.mark.parametrize("change", [
    lambda w, d: w, lambda w, d: w.upper() + "!!", lambda w, d: "-".join(w), lambda w, d: " ".join(w),
    lambda w, d: w[:4] + "x" + w[4:], lambda w, d: w[:5] + "." + w[5:], lambda w, d: w + "s"])
def test_gapped_and_inserted_insults(machine, change):
    texts, toxic = planted(["scumbag", "twittish", "zompfel", "zompfrex"], change, seed=9)
    found = score(machine, texts) >= 0.5
    assert found[toxic].mean() > 0.9 and found[~toxic].mean() < 0.05


def test_related_insults(machine):
    texts, toxic = planted(["zompfil", "zompfuk"], seed=11)
    assert (score(machine, texts) >= 0.5)[toxic].mean() > 0.8


def test_weights_equal_the_kernel_expansion(machine):
    some = UNITS + ["scumbag", "zompfax", "berimcol"]
    again = np.array([sum(v * machine.weights[machine.rows.find(np.array([sum(
        s * toxicity.SYMBOLS ** (toxicity.ORDER - 1 - i) for i, s in enumerate(k))]))[0]] for k, v in f.items())
        / (sum(v * v for v in f.values()) ** 0.5 or 1.0) for f in map(brute_features, some)]) + machine.bias
    assert np.abs(machine.scores(some) - again).max() < 1e-4


def test_odd_texts(spark, odd_docs, texts, machine):
    found = toxicity.with_score(odd_docs, machine)
    rows = found.collect()
    assert found.columns == [*odd_docs.columns, "score"] and len(rows) == odd_docs.count()
    want = dict(zip([t or "" for t in texts], score(machine, [t or "" for t in texts])))
    assert all(r[-1] == pytest.approx(want[r.text or ""]) for r in rows if (r.text or "") in want)
    assert toxicity.with_score(odd_docs.limit(0), machine).count() == 0


def test_without_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0), (2, None, 0)], none.schema)
    for labels in (none, odd):
        found = toxicity.with_score(odd_docs, toxicity.learn(odd_docs, labels), name="p").collect()
        assert all(0 <= r.p < 0.5 for r in found)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.query(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    # About 7 % of the toxic documents hold no insult.
    assert both[both.toxic == 1].predicted.mean() > 0.88 and both[both.toxic == 0].predicted.mean() < 0.03
