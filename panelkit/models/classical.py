"""The comparison models, on pyspark.ml where it has them."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions import hashing
from panelkit.models import boosting
from panelkit.operators import metrics, neighbors, profile
from panelkit.session import cut_lineage, right_size, sum_blocks

VEC, PRED = "_features", "prediction"


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=VEC).transform(df)


def _fitted(estimator) -> Callable:
    """Train a pyspark.ml classifier and predict the test rows."""
    def run(train, test, features, label, key):
        model = estimator(train).setFeaturesCol(VEC).setLabelCol(label).fit(_vectors(train, features))
        return model.transform(_vectors(test, features)).select(
            key, label, F.col(PRED).cast("int").alias(PRED))
    return run


def knn_classify(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str,
                 k: int = 5, **options) -> DataFrame:
    """Majority vote of the k nearest training rows; a tied vote goes to the smaller class."""
    def vec(df):
        return df.select(F.col(key).alias("_id"), F.array(*features).alias("_v"))
    near = neighbors.knn(vec(test), vec(train), k, "_id", "_v", **options)
    return _vote(near, train.select(F.col(key).alias("n_id"), F.col(label).alias("_class")),
                 test.select(key, label), key)


def _vote(near: DataFrame, classes: DataFrame, test: DataFrame, key: str) -> DataFrame:
    votes = near.join(classes, "n_id").groupBy("q_id", "_class").agg(F.count(F.lit(1)).alias("_n"))
    winner = votes.groupBy("q_id").agg(F.max_by("_class", F.struct("_n", -F.col("_class"))).alias(PRED))
    # A row without a finite neighbour keeps its place, with a null prediction.
    return test.join(winner.withColumnRenamed("q_id", key), key, "left")


def gaussian_nb(train: DataFrame, test: DataFrame, vector: str, label: str, key: str,
                smoothing: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes on an array column, fitted and applied as expressions.

    The fit is one row per class and dimension; it rides along as one array, so scoring needs
    neither a join nor a shuffle.
    """
    cells = train.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("j", "x"))
    spread = cells.groupBy("j").agg(F.var_pop("x").alias("v")).agg(F.max("v")).scalar()
    per = cells.groupBy(label, "j").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"),
                                        F.var_pop("x").alias("var"))
    per = per.withColumn("var", F.col("var") + F.lit(smoothing) * spread)
    def column(name):
        return F.transform(F.array_sort(F.collect_list(F.struct("j", name))), lambda s: s[name])
    classes = per.groupBy(label).agg(F.max("n").alias("n"), column("mean").alias("mean"),
                                     column("var").alias("var"))
    table = classes.agg(F.array_sort(F.collect_list(F.struct(
        F.col(label).alias("c"), "n", "mean", "var"))).alias("t")).scalar()
    marked = test.withColumn("_classes", table).withColumn("_x", F.col(vector).cast("array<double>"))
    total = F.aggregate("_classes", F.lit(0).cast("bigint"), lambda s, c: s + c["n"])

    def log_density(c):
        spread = F.zip_with(F.zip_with("_x", c["mean"], lambda x, m: (x - m) * (x - m)), c["var"],
                            lambda d, v: F.ln(F.lit(2.0 * math.pi) * v) + d / v)
        return F.ln(c["n"] / total) - F.lit(0.5) * F.aggregate(spread, F.lit(0.0), lambda s, t: s + t)

    scores = F.transform("_classes", lambda c: F.struct(log_density(c).alias("s"), (-c["c"]).alias("c")))
    return marked.select(key, label, (-F.array_max(scores)["c"]).alias(PRED))


def _naive_bayes(train, test, features, label, key):
    pack = lambda df: df.withColumn("_v", F.array(*features))
    return gaussian_nb(pack(train), pack(test), "_v", label, key)


def fourier_features(df: DataFrame, features: Sequence[str], gamma: float, width: int = 128,
                     seed: int = 42) -> DataFrame:
    """Random Fourier features (Rahimi and Recht 2007): a linear model on them has an RBF kernel."""
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(len(features), width)) * math.sqrt(2.0 * gamma)
    b = rng.uniform(0, 2 * math.pi, size=width)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        z = math.sqrt(2.0 / width) * np.cos(np.stack(x.to_numpy()) @ w + b)
        return pd.Series(list(z))

    return df.withColumn(VEC, array_to_vector(project(F.array(*[F.col(f).cast("double") for f in features]))))


def _rbf_svm(train, test, features, label, key, iterations=1000):
    # The loss settles after some hundred iterations, each several short jobs: no more tasks than the rows are worth.
    train = train.coalesce(max(-(-train.count() // boosting.FEWEST_ROWS), 1))
    variance = train.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    gamma = 1.0 / (len(features) * max(sum(variance) / len(features), 1e-12))
    machine = LinearSVC(maxIter=iterations, regParam=1e-3, featuresCol=VEC, labelCol=label)
    model = machine.fit(fourier_features(train, features, gamma))
    return model.transform(fourier_features(test, features, gamma)).select(
        key, label, F.col(PRED).cast("int").alias(PRED))


def platt(scored: DataFrame, margin: str, label: str, rounds: int = 100) -> tuple[float, float]:
    """Platt's sigmoid: (a, b) such that 1 / (1 + exp(a * margin + b)) is the probability of class 1.

    Newton steps on the smoothed targets of Platt (1999), halved until the loss falls. A step is one aggregate for
    its sums and one for the losses of all halvings. Rows without margin or label don't count; without rows of
    either class the targets alone decide.
    """
    scored = scored.select(F.col(margin).cast("double").alias("f"), F.col(label).cast("double").alias("y")).dropna()
    f, y = F.col("f"), F.col("y")
    size = scored.agg(F.count("y").alias("n"), F.sum("y").alias("ones")).first()
    ones = size["ones"] or 0.0
    zeros = size["n"] - ones
    target = F.when(y == 1, F.lit((ones + 1) / (ones + 2))).otherwise(F.lit(1 / (zeros + 2)))

    def loss(a: float, b: float) -> Column:
        z = F.lit(a) * f + F.lit(b)
        return F.sum(F.when(z >= 0, target * z + F.log1p(F.exp(-z))).otherwise((target - 1) * z + F.log1p(F.exp(z))))

    a, b = 0.0, math.log((zeros + 1) / (ones + 1))
    for _ in range(rounds if size["n"] else 0):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(a) * f + F.lit(b)))
        s = scored.select("f", "y", (target - p).alias("g"), (p * (1 - p)).alias("h")).agg(
            F.sum(f * F.col("g")).alias("ga"), F.sum("g").alias("gb"), F.sum(f * f * F.col("h")).alias("haa"),
            F.sum(f * F.col("h")).alias("hab"), F.sum("h").alias("hbb"), loss(a, b).alias("now")).first()
        if max(abs(s["ga"]), abs(s["gb"])) < 1e-9 * size["n"]:
            break
        haa, hbb = s["haa"] + 1e-12, s["hbb"] + 1e-12
        det = haa * hbb - s["hab"] ** 2
        da, db = (s["hab"] * s["gb"] - hbb * s["ga"]) / det, (s["hab"] * s["ga"] - haa * s["gb"]) / det
        slope, halves = s["ga"] * da + s["gb"] * db, [0.5 ** i for i in range(12)]
        losses = scored.agg(*[loss(a + h * da, b + h * db).alias(f"_{i}") for i, h in enumerate(halves)]).first()
        step = next((h for h, v in zip(halves, losses) if v < s["now"] + 1e-4 * h * slope), None)
        if step is None:
            break
        a, b = a + step * da, b + step * db
    return a, b


def rbf_svm(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, iterations: int = 20,
            folds: int = 3) -> DataFrame:
    """The RBF machine with probabilities: ``key``, ``label``, ``margin``, ``prob`` and ``prediction``.

    The sigmoid is fitted on margins of rows that the machine behind them hasn't seen: ``folds`` machines, each
    without the rows of its fold, which a hash of the key decides. The predictions are the final machine's, by the
    sign of its margin, so near 0 they may differ from ``prob`` >= 0.5.
    """
    variance = train.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    gamma = 1.0 / (len(features) * max(sum(v or 0.0 for v in variance) / len(features), 1e-12))
    machine = LinearSVC(maxIter=iterations, regParam=1e-3, featuresCol=VEC, labelCol=label)
    fold = hashing.pick(key, "platt", folds)
    mapped = fourier_features(train, features, gamma).withColumn("_fold", fold).persist()

    def margins(model, rows):
        return model.transform(rows).withColumn("margin", vector_to_array("rawPrediction")[1])

    held = [margins(machine.fit(mapped.where(F.col("_fold") != k)), mapped.where(F.col("_fold") == k)).select(
        "margin", label) for k in range(folds)]
    unseen = reduce(DataFrame.unionByName, held).persist()
    a, b = platt(unseen, "margin", label)
    out = margins(machine.fit(mapped), fourier_features(test, features, gamma)).select(
        key, label, "margin", (1 / (1 + F.exp(F.lit(a) * F.col("margin") + F.lit(b)))).alias("prob"),
        F.col(PRED).cast("int").alias(PRED))
    unseen.unpersist()
    mapped.unpersist()
    return out


def _histogram_boosting(train, test, features, label, key):
    fitted = boosting.HistogramBoosting.fit(train, features, label)
    return test.select(key, label, (fitted.probability() > 0.5).cast("int").alias(PRED))


def _miss_weight(cells: np.ndarray, y: np.ndarray, stumps) -> np.ndarray:
    total = np.zeros(len(y))
    for alpha, f, cut, left, right in stumps:
        total += alpha * (np.where(cells[f] <= cut, left, right) != y)
    return np.exp(total)


def adaboost(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str,
             rounds: int = 50, bins: int = 32) -> DataFrame:
    """SAMME boosting of one-split trees (Zhu et al. 2009) on quantile-binned features.

    A round is one aggregate: weighted class counts per feature and bin. Rows are binned once and kept in blocks;
    their weights are replayed from the stumps so far, so nothing more is stored per row and no lineage grows.
    """
    names = list(features)
    edges = {r["feature"]: np.unique(r["q"]) for r in profile.quantiles(
        train, names, [i / bins for i in range(1, bins)]).collect()}
    cuts = [edges[f] for f in names]

    def binned(frames):
        for pdf in frames:
            if pdf["_y"].isna().any():
                raise ValueError("row without a label")
            x = pdf[names].to_numpy("float64")
            # A value is at most a cut exactly if its bin is at most the cut's number; NaN lies beyond all cuts.
            cells = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
            yield pd.DataFrame({"x": [cells.astype("int32").tobytes()], "y": [pdf["_y"].to_numpy("int64").tobytes()]})

    data = cut_lineage(train.select(
        F.col(label).cast("int").alias("_y"), *[F.col(f).cast("double").alias(f) for f in names]).mapInPandas(
        binned, "x binary, y binary"))
    blocks = data.rdd
    stumps: list[tuple[float, int, int, int, int]] = []
    size = len(names) * bins * 2

    def histogram() -> np.ndarray:
        known = list(stumps)

        def partial(number, rows):
            total = np.zeros((len(names), bins, 2))
            for x, y in rows:
                x, y = np.frombuffer(x, np.int32).reshape(len(names), -1), np.frombuffer(y, np.int64)
                w = _miss_weight(x, y, known)
                for j in range(len(names)):
                    total[j] += np.bincount(x[j] * 2 + y, weights=w, minlength=bins * 2)[:bins * 2].reshape(bins, 2)
            yield number, total.tobytes()

        return sum_blocks(blocks.mapPartitionsWithIndex(partial), size).reshape(len(names), bins, 2)

    for _ in range(rounds):
        counts = histogram()
        below = counts.cumsum(axis=1)
        all_, best = below[0, -1], None
        for j, c in enumerate(cuts):
            for i in range(len(c)):
                low = below[j, i]
                high = all_ - low
                left, right = int(low[1] > low[0]), int(high[1] > high[0])
                error = (low[1 - left] + high[1 - right]) / all_.sum()
                if best is None or error < best[0] - 1e-12:
                    best = (error, j, i, left, right)
        if best is None or best[0] >= 0.5:
            break
        stumps.append((math.log((1.0 - best[0]) / max(best[0], 1e-10)), *best[1:]))
        if best[0] <= 0:
            break
    data.unpersist()

    def vote(s) -> Column:
        side = F.when(F.col(names[s[1]]) <= F.lit(float(cuts[s[1]][s[2]])), F.lit(s[3])).otherwise(F.lit(s[4]))
        return F.when(side == 1, F.lit(s[0])).otherwise(F.lit(-s[0]))

    margin = sum((vote(s) for s in stumps), F.lit(0.0))
    return test.select(key, label, (margin > 0).cast("int").alias(PRED))


def models(seed: int = 42, forest_depth: int = 30, svm_iterations: int = 1000) -> dict[str, Callable]:
    """The nine baselines by name; each takes (train, test, features, label, key).

    ``forest_depth`` is the library's bound for trees that otherwise grow freely; ``svm_iterations`` bounds a fit that
    ends when its loss has settled, as that of the logistic regression.
    """
    # The names as reports give them.
    return {
        "KNN": knn_classify,
        "Gradient Boost": _fitted(lambda _: GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed)),
        "Random Forest": _fitted(lambda _: RandomForestClassifier(
            numTrees=100, maxDepth=forest_depth, seed=seed)),
        "Naïve Bayes": _naive_bayes,
        "XG Boost": _histogram_boosting,
        "Decision Tree": _fitted(lambda _: DecisionTreeClassifier(maxDepth=6, seed=seed)),
        "SVM": lambda *args: _rbf_svm(*args, iterations=svm_iterations),
        "Logistic Regression": _fitted(lambda train: LogisticRegression(
            maxIter=1000, regParam=1.0 / max(train.count(), 1), elasticNetParam=0.0, standardization=False)),
        "ADA Boost": adaboost,
    }


def benchmark(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str,
              chosen: Mapping[str, Callable] | None = None) -> DataFrame:
    """Metrics of every model on the test rows, one row each; a model that fails raises."""
    spark, rows = train.sparkSession, []
    order = ("Accuracy", "F1 Score", "Precision", "Recall")
    train, test = train.persist(), test.persist()
    try:
        small = right_size(train)
        for name, fit in (chosen or models()).items():
            scored = metrics.binary_metrics(fit(small, test, list(features), label, key), label, PRED).first()
            rows.append((name, *[float(scored[m]) for m in order]))
    finally:
        train.unpersist()
        test.unpersist()
    return spark.createDataFrame(
        rows, "Model string, Accuracy double, `F1 Score` double, Precision double, Recall double")
