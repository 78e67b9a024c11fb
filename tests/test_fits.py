import heapq

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import queries as registry
from panelkit import session
from panelkit.models import boosting, classical
from panelkit.models.perceptron import COLUMN_WEIGHTS, Perceptron
from panelkit.operators import impute
from panelkit.plans import evaluation


def made(spark, rows, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, 3)), 2)
    x[rng.random(x.shape) < 0.05] = np.nan
    y = ((np.nan_to_num(x[:, 0]) * np.nan_to_num(x[:, 1]) + 0.5 * rng.normal(size=rows)) > 0).astype(int)
    table = [(i, *[None if np.isnan(v) else float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(table, "id int, a double, b double, c double, y int")


def brute_boosting(x, y, cuts, rounds, depth, leaves, rate, least):
    """One leaf at a time, always the best one, each split by trying every bin on the rows themselves."""
    p0 = y.mean()
    margin = np.full(len(y), np.log((p0 * len(y) + 1e-9) / ((1 - p0) * len(y) + 1e-9)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def best(rows):
            score = lambda r: g[r].sum() ** 2 / h[r].sum()
            top = (boosting.LEAST_GAIN,)
            for j, c in enumerate(cuts):
                for i, v in enumerate(c):
                    low, high = rows[x[rows, j] <= v], rows[~(x[rows, j] <= v)]
                    if min(len(low), len(high)) >= least and min(h[low].sum(), h[high].sum()) > 1e-3:
                        gain = score(low) + score(high) - score(rows)
                        if gain > top[0] + 1e-12:
                            top = (gain, low, high)
            return top
        everything, count = np.arange(len(y)), 1
        grown, heap = [], [(-best(everything)[0], 0, 0, everything)]
        tick = 1
        while heap:
            _, _, level, rows = heapq.heappop(heap)
            found = best(rows) if level < depth and count < leaves else (0,)
            if len(found) == 1:
                grown.append(rows)
                continue
            count += 1
            for part in found[1:]:
                heapq.heappush(heap, (-best(part)[0] if level + 1 < depth else 0.0, tick, level + 1, part))
                tick += 1
        for rows in grown:
            margin[rows] -= rate * g[rows].sum() / h[rows].sum()
    return margin


@pytest.mark.parametrize("leaves,depth", [(4, 3), (31, 2)])
def test_boosting_equals_brute_force(spark, leaves, depth):
    x, y, df = made(spark, 240)
    options = dict(rounds=4, depth=depth, leaves=leaves, rate=0.3, bins=8, least_rows=10)
    fitted = boosting.HistogramBoosting.fit(df.repartition(3), ["a", "b", "c"], "y", keep_every=3, **options)
    cuts = boosting.edges(df, ["a", "b", "c"], 8)
    for own, values in zip(cuts, x.T):
        known = np.sort(values[~np.isnan(values)])
        assert len(own) == 7 and np.isin(own, known).all()
        assert np.abs(np.searchsorted(known, own, side="right") / len(known) - np.arange(1, 8) / 8).max() < 0.02
    want = brute_boosting(x, y, cuts, 4, depth, leaves, 0.3, 10)
    assert len(fitted.trees) == 4
    assert np.allclose(fitted.margins(x), want, atol=1e-8)
    got = df.select("id", fitted.probability().alias("p")).orderBy("id").toPandas()["p"]
    assert np.allclose(got, 1 / (1 + np.exp(-want)))


def test_boosting_of_odd_input(spark):
    _, _, df = made(spark, 60)
    names = ["a", "b", "c"]
    for odd in (df.limit(0), df.where("y = 1"), df.withColumn("y", F.lit(None).cast("int"))):
        assert not boosting.HistogramBoosting.fit(odd, names, "y", rounds=2).trees
    same = df.withColumns({"a": F.lit(1.0), "b": F.lit(None).cast("double"), "c": F.lit(2.0)})
    assert not boosting.HistogramBoosting.fit(same, names, "y", rounds=2).trees
    doubled = df.unionAll(df)
    assert boosting.HistogramBoosting.fit(doubled, names, "y", rounds=1, least_rows=5, bins=8).trees


def test_platt_finds_the_minimum(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * f - 0.5)))).astype(int)
    df = spark.createDataFrame([*zip(map(float, f), map(int, y)), (None, 1), (0.5, None)], "m double, y int")
    a, b = classical.platt(df, "m", "y")
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    p = 1 / (1 + np.exp(a * f + b))
    assert abs(((t - p) * f).sum()) < 1e-5 and abs((t - p).sum()) < 1e-5
    assert -2.8 < a < -1.3
    assert classical.platt(df.limit(0), "m", "y") == (0.0, 0.0)


def test_svm_probabilities_are_calibrated(spark):
    x, y, df = made(spark, 600, seed=8)
    df = df.na.fill(0.0)
    out = classical.rbf_svm(df.where("id < 400"), df.where("id >= 400"), ["a", "b", "c"], "y", "id").toPandas()
    assert len(out) == 200 and out["prob"].between(0, 1).all()
    loss = -np.log(np.where(out["y"] == 1, out["prob"], 1 - out["prob"])).mean()
    rate = y[:400].mean()
    blind = -np.log(np.where(out["y"] == 1, rate, 1 - rate)).mean()
    assert loss < 0.85 * blind
    assert ((out["margin"] > 0) == (out["prediction"] == 1)).all()


def test_wide_perceptron_scores_like_the_fitted_model(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    rng = np.random.default_rng(0)
    names = [f"x{i}" for i in range(11)]
    x = rng.normal(size=(200, 11))
    df = spark.createDataFrame([(*map(float, r), int(r[0] + r[1] > 0)) for r in x],
                               ", ".join(f"{n} double" for n in names) + ", y int")
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(df)
    machine = MultilayerPerceptronClassifier(layers=[11, 128, 64, 32, 2], maxIter=15, seed=42, featuresCol="v", labelCol="y")
    fitted = machine.fit(vectors)
    ours = Perceptron([11, 128, 64, 32, 2], fitted.weights.toArray())
    assert ours.wide and len(ours.weights) > COLUMN_WEIGHTS
    got = fitted.transform(vectors).select(
        vector_to_array("probability")[1].alias("want"), ours.score([F.col(n) for n in names]).alias("got")).toPandas()
    assert np.allclose(got["want"], got["got"], atol=1e-12)


def test_expected_gradients(spark):
    rng = np.random.default_rng(2)
    net = Perceptron([3, 5, 4, 2], rng.normal(size=3 * 5 + 5 + 5 * 4 + 4 + 4 * 2 + 2))
    x, background = rng.normal(size=(7, 3)), rng.normal(size=(30, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    inputs = [F.col(c) for c in "abc"]
    rows = df.select("id", net.expected_gradients(inputs, background).alias("e"), net.probability(inputs).alias("p"),
                     net.batch_probability(inputs).alias("q")).orderBy("id").toPandas()
    assert np.allclose(rows["p"], rows["q"])
    from panelkit.models.perceptron import _forward, _gradient
    f = lambda v: _forward(net._steps(), v)[-1][:, 0]
    step = 1e-6 * np.eye(3)
    numeric = np.stack([(f(x + e) - f(x - e)) / 2e-6 for e in step], axis=1)
    assert np.allclose(_gradient(net._steps(), x), numeric, atol=1e-7)
    assert np.allclose(np.stack(rows["e"]).sum(axis=1), rows["p"] - f(background).mean(), atol=1e-7)
    assert df.select(net.expected_gradients(inputs, background[:0]).alias("e")).first()["e"] is None


def counting(df):
    """``df``, and a counter of the rows made for its readers."""
    made_rows = df.sparkSession.sparkContext.accumulator(0)

    def read(frames):
        for pdf in frames:
            made_rows.add(len(pdf))
            yield pdf

    return df.mapInPandas(read, df.schema), made_rows


def test_the_table_makes_its_rows_once(spark, cohort):
    rows, made_rows = counting(cohort)
    chosen = {"Naïve Bayes": classical.models()["Naïve Bayes"]}
    table = evaluation.comparison_table(rows, "row_id", sweeps=1, chosen=chosen).collect()
    assert [r["Model"] for r in table] == ["Naïve Bayes"]
    assert made_rows.value == cohort.count()


def test_the_registered_table_fits_all_of_it(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(11)
    kinds = ["click", "view", "error", "signup", "purchase"]
    rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=int(rng.integers(6000))), i % 60,
             kinds[int(rng.integers(5))], float(rng.uniform(1, 100)), '{"k": %d}' % rng.integers(100))
            for i in range(900)] + [
        (900 + u, pd.Timestamp("2024-01-05 06:00:00"), u, "purchase", 250.0, '{"k": 1}') for u in range(25)]
    spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
                          ).write.parquet(str(tmp_path / "events.parquet"))
    imputers, forests = [], []
    fit, grow = impute.ChainedImputer.fit, classical.RandomForestClassifier.fit

    def imputer_fit(self, *args):
        imputers.append(fit(self, *args))
        return self

    def forest_fit(self, *args):
        forests.append(self)
        return grow(self, *args)

    def benchmark(train, test, features, label, key, chosen=None):
        every = chosen or classical.models()
        assert len(every) == 9
        return every["Random Forest"](train, test, features, label, key)

    monkeypatch.setattr(impute.ChainedImputer, "fit", imputer_fit)
    monkeypatch.setattr(classical.RandomForestClassifier, "fit", forest_fit)
    monkeypatch.setattr(classical, "benchmark", benchmark)
    assert registry.queries()["baseline_table"](spark, str(tmp_path)).count() > 0
    [imputer], [forest] = imputers, forests
    targets = [s.target for s in imputer.steps]
    assert len(set(targets)) > 1 and len(targets) == 10 * len(set(targets))
    assert forest.getMaxDepth() == 30 and forest.getNumTrees() == 100


def test_the_machine_is_fitted_until_its_loss_settles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    y = x[:, 0] * x[:, 1] + 0.1 * rng.normal(size=120) > 0
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "id int, a double, b double, y int").repartition(6)
    machines, fit = [], classical.LinearSVC.fit

    def machine_fit(self, rows, *args):
        machines.append((self, rows.rdd.getNumPartitions(), fit(self, rows, *args)))
        return machines[-1][-1]

    monkeypatch.setattr(classical.LinearSVC, "fit", machine_fit)
    assert classical.models()["SVM"](df, df, ["a", "b"], "y", "id").count() == 120
    [(machine, tasks, model)] = machines
    assert 20 < model.summary().totalIterations < machine.getMaxIter() and tasks == 1


def test_stumps_bin_the_rows_once(spark):
    _, _, df = made(spark, 240)
    df = df.na.fill(0.0)
    rows, made_rows = counting(df)
    found = classical.adaboost(rows, df, ["a", "b", "c"], "y", "id", rounds=8, bins=8).collect()
    # Two evaluations for the quantiles, one for the bins, none a round.
    assert len(found) == 240 and made_rows.value <= 3 * 240


def test_blocks_are_added_in_a_tree(spark):
    parts = spark.sparkContext.parallelize(range(40), 40).mapPartitionsWithIndex(
        lambda i, rows: [(i, np.array([float(i), 1.0]).tobytes())])
    assert session.sum_blocks(parts, 2).tolist() == [780.0, 40.0]
    assert session.sum_blocks(spark.sparkContext.emptyRDD(), 2).tolist() == [0.0, 0.0]
