import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit import catalog
from panelkit.functions import clinical
from panelkit.models import classical, perceptron
from panelkit.operators import balance, explain, impute, neighbors, profile, split
from panelkit.plans import evaluation, model
from tests.conftest import made_cohort

FEATURES = list(catalog.FEATURES)
LABEL = catalog.LABEL


@pytest.fixture(scope="module")
def clean(spark):
    return made_cohort(spark, 160, 120)


def test_perceptron_as_columns_equals_the_fitted_model(spark, clean):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler
    data = profile.standardize(clean, FEATURES, profile.scaler(clean, FEATURES))
    net = perceptron.Perceptron.fit(data, FEATURES[:5], LABEL, (4, 3), 30)
    machine = MultilayerPerceptronClassifier(layers=[5, 4, 3, 2], maxIter=30, seed=42, featuresCol="v", labelCol=LABEL)
    vectors = VectorAssembler(inputCols=FEATURES[:5], outputCol="v").transform(data)
    want = machine.fit(vectors).transform(vectors).select("row_id", "probability").collect()
    got = data.select("row_id", net.probability([F.col(f) for f in FEATURES[:5]]).alias("p")).collect()
    assert np.allclose([r["p"] for r in got], [r["probability"][1] for r in want])


def test_components_equal_the_decomposition(spark, clean):
    data = profile.standardize(clean, FEATURES, profile.scaler(clean, FEATURES))
    fitted = perceptron.Components.fit(data, FEATURES, 11)
    x = data.select(*FEATURES).toPandas().to_numpy()
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(np.abs(fitted.matrix), np.abs(vectors[:, ::-1][:, :11]), atol=1e-6)
    latent = data.select(*[c.alias(f"l{i}") for i, c in enumerate(fitted.latents([F.col(f) for f in FEATURES]))])
    assert np.allclose(latent.toPandas().to_numpy(), x @ fitted.matrix)


def test_latent_model_end_to_end(spark, clean, tmp_path):
    fitted = model.LatentModel.fit(clean, "row_id", LABEL, hidden=(5,), max_iter=20, background_rows=30)
    fitted.save(spark, str(tmp_path / "m"))
    back = model.LatentModel.load(spark, str(tmp_path / "m"))
    assert back.features == fitted.features and back.classifier.layers == [11, 5, 2]
    scored = [m.probabilities(clean, ["row_id", LABEL]).toPandas() for m in (fitted, back)]
    assert np.array_equal(scored[0]["prob"], scored[1]["prob"])
    assert ((scored[0]["prob"] > 0.5) == scored[0][LABEL]).mean() > 0.95
    row = back.explain(clean.limit(1), "row_id").first()
    assert 0 <= row["sepsis_probability"] <= 1 and len(row["latent_representation"]) == 11
    assert len(row["shap_waterfall"]) == 11
    assert {w["impact"] for w in row["shap_waterfall"]} <= {"contributing", "offsetting"}
    size = [abs(w["shap_value"]) for w in row["shap_waterfall"]]
    assert size == sorted(size, reverse=True)


@pytest.mark.parametrize("trained", [False, True])
def test_record_model(spark, clean, tmp_path, trained):
    vitals = dict(zip(FEATURES, (6, 40.22, 105, 26.5, 9, 28, 24, 0, 3.8, .7, 4.2, .6, 91, 1.7, 90, 3.8, 7.25, 7.9, 42)))
    df = spark.createDataFrame([(1, {k: str(v) for k, v in vitals.items()})], "id int, vitals map<string,string>")
    fitted = model.RecordModel.fit(clean, "row_id", LABEL, max_iter=5) if trained else model.RecordModel()
    fitted.save(spark, str(tmp_path / "r"))
    row = model.RecordModel.load(spark, str(tmp_path / "r")).score_records(df, ["id"]).first()
    assert 0 <= row["prediction_probability"] <= 1 and row["decision_threshold"] == 0.30
    assert len(row["shap_waterfall"]) == 11 and row["warnings"] == []
    assert {w["feature"]: w["patient_value"] for w in row["shap_waterfall"]}["Temp"] == 40.22
    assert row["disclaimer"] and row["model_architecture"] == ("perceptron 11 -> 8 -> 2" if trained else "bedside rule")


def test_wide_record_model_is_explained_by_gradients(spark, clean):
    fitted = model.RecordModel.fit(clean, "row_id", LABEL, hidden=(128, 64, 32), max_iter=5)
    df = spark.createDataFrame([(1, {"HR": "120", "Temp": "39.5"})], "id int, vitals map<string,string>")
    row = fitted.score_records(df, ["id"]).first()
    total = sum(w["shap_value"] for w in row["shap_waterfall"])
    values = {w["feature"]: w["patient_value"] for w in row["shap_waterfall"]}
    assert 0 <= row["prediction_probability"] <= 1 and row["model_architecture"] == "perceptron 11 -> 128 -> 64 -> 32 -> 2"
    background = spark.createDataFrame([(list(map(float, r)),) for r in (fitted.background - fitted.mean) / fitted.scale],
                                       "x array<double>")
    base = background.select(F.avg(fitted.classifier.batch_probability([F.col("x")[i] for i in range(11)]))).first()[0]
    assert values["Temp"] == 39.5 and abs(total - (row["prediction_probability"] - base)) < 2e-3
    with pytest.raises(ValueError):
        fitted.score_records(df, ["id"], method="perturbation")


def test_a_background_of_any_size_is_refused(spark, clean):
    with pytest.raises(ValueError):
        explain.attributions(clean, catalog.BOTTLENECK, clinical.rule_probability,
                             clean.crossJoin(spark.range(200)).select(clean.columns), used=clinical.RULE_DEFAULTS)


def brute_attributions(score, x, background):
    """The definition, cell by cell."""
    base, out = np.mean([score(b) for b in background]), []
    for row in x:
        drops = []
        for i in range(len(row)):
            drops.append(np.mean([score(row) - score(np.r_[row[:i], b[i], row[i + 1:]]) for b in background]))
        gap, total = score(row) - base, sum(drops)
        out.append(np.array(drops) * gap / total if abs(total) > 1e-6 else np.full(len(row), gap / len(row)))
    return np.array(out)


@pytest.mark.parametrize("rows", [3, 300])
def test_attributions_use_the_whole_background(spark, rows):
    rng = np.random.default_rng(1)
    x, background = rng.normal(size=(6, 3)).round(3), np.arange(rows * 3).reshape(rows, 3).astype(float)
    x[0] = 0
    names = ["a", "b", "c"]
    frame = lambda m: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "id int, a double, b double, c double")
    want = brute_attributions(lambda v: v[0] * v[1] + v[2] ** 2, x, background)
    score = lambda v: v["a"] * v["b"] + v["c"] * v["c"]
    for reference in (frame(background), background):
        got = explain.attributions(frame(x), names, score, reference).orderBy("id").toPandas()
        assert np.allclose(np.stack(got["attributions"]), want)
    assert explain.attributions(frame(x), names, score, frame(background).limit(0)).first()["attributions"] is None


def test_attributions_add_up(spark, clean):
    ref = explain.background(clean, "row_id", 250)
    out = explain.attributions(clean, catalog.BOTTLENECK, clinical.rule_probability, ref,
                               used=clinical.RULE_DEFAULTS).withColumn("f", clinical.rule_probability()).toPandas()
    base = ref.select(clinical.rule_probability().alias("p")).toPandas()["p"].mean()
    assert len(ref.collect()) == 250
    assert np.allclose(np.stack(out["attributions"]).sum(axis=1), out["f"] - base)


def test_neighbours_by_cells_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 4)), 2)
    x[:100] = x[0]  # a third of the rows coincide
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    def run(**options):
        return neighbors.knn(df, df, 5, "id", "v", exclude_self=True, **options).toPandas().sort_values(
            ["q_id", "rank"]).reset_index(drop=True)
    small, cells = run(), run(broadcast_bytes=1000, chunk_rows=40)
    ids, parts = np.arange(300), []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(neighbors, "REFERENCES", 37)
        parts = pd.concat(neighbors._nearest(ids, x, ids, x, 5, True)).sort_values(["q_id", "dist", "n_id"])
    assert parts["n_id"].tolist() == small["n_id"].tolist()
    pd.testing.assert_frame_equal(small, cells)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), neighbors.DECIMALS)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert np.array_equal(small["n_id"].to_numpy().reshape(-1, 5), want)


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-20, 0.0), (1.0, 1e6), (1e18, 0.0), (1e200, 0.0)])
def test_bounds_lose_no_neighbour(monkeypatch, scale, offset):
    """Many blocks, ties, rows that are not finite and ids that come twice; few distances are worked out."""
    monkeypatch.setattr(neighbors, "REFERENCES", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 6)) * scale + offset
    x[100:160], x[300], x[301], x[302:310] = x[100], np.nan, np.inf, x[302]
    ids = np.sort(np.r_[np.arange(890), np.arange(10)])
    with np.errstate(all="ignore"):
        d = neighbors._distances(x, x)
    d[(ids[:, None] == ids[None]) | ~np.isfinite(d)] = np.inf
    want = [(ids[i], ids[j], d[i, j]) for i in range(900) for j in np.argsort(d[i], kind="stable")[:5] if d[i, j] < np.inf]
    pairs, counted = [], neighbors._pair_distances
    monkeypatch.setattr(neighbors, "_pair_distances", lambda q, r, a, b: pairs.append(len(a)) or counted(q, r, a, b))
    got = pd.concat([pd.DataFrame({"q_id": [], "n_id": [], "dist": []}), *neighbors._nearest(ids, x, ids, x, 5, True)])
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted((float(a), float(b), float(c)) for a, b, c in want)
    if scale == 1.0 and not offset:
        assert sum(pairs) < 900 * 900 / 4


def test_balancing_reaches_exact_sizes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=19)), int(i >= 190)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, " + ", ".join(f"{f} double" for f in FEATURES) + f", {LABEL} int")
    def sizes(t0, t1, **options):
        out = balance.balance(df, "row_id", LABEL, FEATURES, t0, t1, **options)
        counts = {r[LABEL]: (r["n"], r["k"]) for r in out.groupBy(LABEL).agg(
            F.count("*").alias("n"), F.countDistinct("row_id").alias("k")).collect()}
        return counts
    assert sizes(50, 40, majority="centroids") == {0: (50, 50), 1: (40, 40)}
    assert sizes(50, 5) == {0: (50, 50), 1: (5, 5)}
    assert sizes(250, 10) == {0: (250, 250), 1: (10, 10)}
    one = df.filter("row_id < 191")
    assert balance.balance(one, "row_id", LABEL, FEATURES, 190, 4, minority="pairs").filter(F.col(LABEL) == 1).count() == 4
    with pytest.raises(ValueError):
        balance.balance(one, "row_id", LABEL, FEATURES, 190, 4)
    with pytest.raises(ValueError):
        balance.cluster_centroids(df.withColumns({f: F.lit(1.0) for f in FEATURES}), "row_id", FEATURES, 5)
    with pytest.raises(ValueError):
        balance.cluster_centroids(df, "row_id", FEATURES, balance.MOST_CENTROIDS + 1)
    assert balance.balance(df.filter(F.col(LABEL) == 0), "row_id", LABEL, FEATURES, 5, 5).count() == 190


def test_synthetic_rows_lie_between_originals(spark):
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(30)], "id int, a double, b double")
    made = balance.smote(df, "id", ["a", "b"], 200, 3).toPandas()
    assert len(made) == 200 and np.allclose(made.a, -made.b) and made.a.between(0, 29).all()


def test_imputation_leaves_observed_cells_alone(spark, cohort, tmp_path):
    im = impute.ChainedImputer(FEATURES, max_iter=1)
    with pytest.raises(RuntimeError):
        im.transform(cohort, "row_id")
    out = im.fit_transform(cohort, "row_id").toPandas().set_index("row_id").sort_index()
    before = cohort.toPandas().set_index("row_id").sort_index()
    assert not out[FEATURES].isna().any().any()
    seen = before[FEATURES].notna()
    assert (out[FEATURES].where(seen) == before[FEATURES].where(seen)).where(seen, True).all().all()
    assert out[FEATURES].to_numpy().min() >= -50 and out[FEATURES].to_numpy().max() <= 300
    im.save(cohort.sparkSession, str(tmp_path / "im"))
    again = impute.ChainedImputer.load(cohort.sparkSession, str(tmp_path / "im")).transform(cohort, "row_id")
    assert np.allclose(again.toPandas().set_index("row_id").sort_index()[FEATURES], out[FEATURES])
    whole = impute.ChainedImputer(FEATURES).fit(im.transform(cohort, "row_id"), "row_id")
    assert whole.steps == []
    fewer = im.transform(cohort.drop("BUN"), "row_id")
    assert "BUN" in fewer.columns and fewer.filter("BUN is null").isEmpty()


def test_imputation_recovers_a_linear_relation(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(10, 3, 300)
    pdf = pd.DataFrame({"id": range(300), "a": a, "b": 2 * a + 1, "c": rng.normal(size=300), "e": np.nan})
    hole = rng.random(300) < 0.2
    truth = pdf["b"].copy()
    pdf.loc[hole, "b"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    for schedule in ("sequential", "block"):
        im = impute.ChainedImputer(["a", "b", "c", "e"], 3, sample_posterior=False, schedule=schedule)
        out = im.fit_transform(df, "id").toPandas().sort_values("id")
        assert np.allclose(out["b"], truth, atol=0.05) and (out["e"] == 0).all()


def test_ridge_follows_its_closed_form():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(500, 4)), np.array([1.0, -2.0, 0.0, 3.0])
    y = x @ w + rng.normal(0, 0.1, 500)
    x, y = x - x.mean(0), y - y.mean()
    coef, spread, noise = impute.bayesian_ridge(500, x.T @ x, x.T @ y, y @ y)
    assert np.allclose(coef, w, atol=0.02) and noise == pytest.approx(0.01, rel=0.2)
    assert np.allclose(spread, noise * np.linalg.inv(x.T @ x), rtol=0.05, atol=1e-7)


def test_group_folds_keep_entities_apart(spark):
    df = spark.range(60).select("id", (F.col("id") % 10).alias("g"), (F.col("id") % 10 < 4).cast("int").alias("y"))
    out = split.group_kfold(df, "g", "y", 2)
    assert split.leaking_groups(out, "g").isEmpty()
    parts = [out.filter(f"fold = {f}").select("g") for f in (0, 1)]
    assert parts[0].intersect(parts[1]).isEmpty() and {p.count() for p in parts} == {30}
    test = split.holdout(df, "id", "y").filter("is_test").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in test} == {0: 7, 1: 4}


def test_grouped_cross_validation(spark, cohort):
    df = cohort.withColumn("g", F.col("row_id") % 12)
    out = evaluation.leakage_free_cv(df, "row_id", group="g", k=2, max_iter=5, sweeps=1,
                                     targets=(60, 50)).collect()
    assert [r["Fold"] for r in out] == ["1", "2", "Mean ± SD"]
    assert " ± " in out[2]["Accuracy"]


def test_comparison_models(spark, clean):
    data = profile.standardize(clean, FEATURES, profile.scaler(clean, FEATURES))
    tagged = split.holdout(data, "row_id", LABEL)
    chosen = {n: m for n, m in classical.models().items() if n in ("KNN", "Naïve Bayes", "Decision Tree", "ADA Boost")}
    parts = tagged.filter("not is_test"), tagged.filter("is_test"), FEATURES, LABEL, "row_id"
    got = {r["Model"]: r for r in classical.benchmark(*parts, chosen).collect()}
    assert all(got[n]["Accuracy"] > 0.9 for n in chosen)

    def broken(*_):
        raise ValueError("no fit")
    with pytest.raises(ValueError):
        classical.benchmark(*parts, {"Broken": broken})


def test_splits_keep_null_labels_and_groups_and_repeated_keys(spark):
    rows = [(i // 2, None if i % 10 == 0 else i % 3, None if i % 7 == 0 else i % 5) for i in range(200)] + [(3, 1, 1)] * 30
    df = spark.createDataFrame(rows, "id int, y int, g int")
    held = split.holdout(df, "id", "y").groupBy("y").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()
    assert sum(r["n"] for r in held) == 230 and all(r["t"] == r["n"] // 5 for r in held)
    folds = split.stratified_kfold(df, "id", "y", 4).groupBy("y", "fold").count().collect()
    assert sum(r["count"] for r in folds) == 230
    for y in (None, 0, 1, 2):
        sizes = [r["count"] for r in folds if r["y"] == y]
        assert max(sizes) - min(sizes) <= 1
    grouped = split.group_kfold(df, "g", "y", 2)
    assert grouped.count() == 230 and split.leaking_groups(grouped, "g").isEmpty()
    for n in (0, 1, 17, 229, 230, 500):
        assert balance.downsample_exact(df, "id", n).count() == min(n, 230)


def test_selector_must_be_fitted(spark, clean):
    from panelkit.operators import selection
    with pytest.raises(RuntimeError):
        selection.TwoTierSelector().transform(clean)
