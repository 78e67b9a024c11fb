import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit import catalog
from panelkit.functions import clinical, hashing, special
from panelkit.operators import explain, metrics, profile, ranking, selection
from panelkit.sources import links, records


def test_sirs_fixtures(spark):
    df = spark.createDataFrame([(36.8, 16.0), (39.5, 28.0), (35.2, 24.0), (None, None)], "Temp double, Resp double")
    assert [r["SIRS"] for r in clinical.with_sirs(df).collect()] == [0, 2, 2, 0]


def test_white_cell_units(spark):
    values = [13, 3, 100, 101, 3999, 4000, 12000, 12001, 0]
    df = spark.createDataFrame([(float(v),) for v in values], "WBC double")
    assert [int(r["SIRS"]) for r in clinical.with_sirs(df).collect()] == [1, 1, 1, 1, 1, 0, 0, 1, 0]


def test_sirs_is_kept_unless_any_row_lacks_it(spark):
    full = spark.createDataFrame([(39.0, 0.0), (39.0, 3.0)], "Temp double, SIRS double")
    assert [r["SIRS"] for r in clinical.with_sirs(full, "if_any_null").collect()] == [0, 3]
    gap = spark.createDataFrame([(39.0, None), (39.0, 3.0)], "Temp double, SIRS double")
    assert [r["SIRS"] for r in clinical.with_sirs(gap, "if_any_null").collect()] == [1, 1]


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(55.0, 9.5), (15.0, 5.0), (None, float("nan")), (36.5, 7.4)], "Temp double, pH double")
    got = [tuple(r) for r in clinical.clip_limits(df).collect()]
    assert got == [(43.0, 7.8), (30.0, 6.8), (None, None), (36.5, 7.4)]


def test_records_are_defaulted_clipped_and_explained(spark):
    df = spark.createDataFrame([({"Temp": "37", "Resp": "16"},), ({"Temp": "45", "Resp": "x", "pH": "NaN", "BUN": ""},)],
                               "vitals map<string,string>")
    sparse, odd = records.from_map(df).collect()
    assert len(sparse["warnings"]) == 17
    assert sparse["warnings"][0] == "BaseExcess was not provided; defaulted to physiological normal (0.00)."
    assert odd["Temp"] == 43.0 and odd["Resp"] == 16.0 and odd["BUN"] == 13.5
    assert "Temp (45.0) was outside biological limits [30.0, 43.0]; clipped to 43.0." in odd["warnings"]
    assert "Resp was invalid; defaulted to physiological normal (16.00)." in odd["warnings"]
    assert odd["pH"] == pytest.approx(7.4)


def test_rule_agrees_as_columns_and_as_matrix(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 11)) * 3 + [catalog.midpoint(f) for f in catalog.BOTTLENECK]
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([[None if math.isnan(v) else float(v) for v in r] for r in x],
                               ", ".join(f"{f} double" for f in catalog.BOTTLENECK))
    got = [r["p"] for r in df.select(clinical.rule_probability().alias("p")).collect()]
    def rule(row):
        v = {f: clinical.RULE_DEFAULTS.get(f, 0.0) if math.isnan(a) else a for f, a in zip(catalog.BOTTLENECK, row)}
        hits = [(2.0, v["Temp"] > 38.3), (1.5, v["Temp"] < 36.0), (1.2, v["Resp"] > 22), (0.8, v["SIRS"] >= 2),
                (0.9, abs(v["BaseExcess"]) > 3), (0.8, v["Creatinine"] > 1.3)]
        return 1 / (1 + math.exp(3.5 - sum(w for w, hit in hits if hit)))
    assert np.allclose(got, [rule(r) for r in x])


@pytest.mark.parametrize("text,value,warning", [
    ("1d", 36.65, "Temp was invalid; defaulted to physiological normal (36.65)."),
    ("7f", 36.65, "Temp was invalid; defaulted to physiological normal (36.65)."),
    ("Infinity", 36.65, "Temp was invalid; defaulted to physiological normal (36.65)."),
    ("nan", 36.65, "Temp was not provided; defaulted to physiological normal (36.65)."),
    (" 3.7e1 ", 37.0, None), ("12345678", 43.0, "Temp (12345678.00) was outside biological limits [30.0, 43.0]; clipped to 43.0.")])
def test_what_counts_as_a_number(spark, text, value, warning):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    row = clinical.accept_record(df, {"Temp": F.col("t")}, ["id"]).first()
    assert row["Temp"] == pytest.approx(value)
    own = [w for w in row["warnings"] if w.startswith("Temp ")]
    assert own == ([warning] if warning else [])


def test_risk_bands(spark):
    df = spark.createDataFrame([(0.61,), (0.30,), (0.299,)], "p double")
    bands = clinical.risk_band("p")
    rows = df.select(*[c.alias(n) for n, c in bands.items()]).collect()
    assert [r["alert_level"] for r in rows] == ["HIGH", "MODERATE", "LOW"]
    assert "probability 30.0% exceeds" in rows[1]["interpretation_6h"]
    assert [r["is_above_threshold"] for r in rows] == [True, True, False]


@pytest.mark.parametrize("n", [1, 3, 4, 7, 60, 1500])
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"a": np.round(rng.exponential(5, n), 1), "b": rng.normal(size=n)})
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["feature"]: r["q"] for r in profile.quantiles(spark.createDataFrame(pdf), ["a", "b"], probs).collect()}
    for c in pdf:
        assert np.allclose(got[c], np.quantile(pdf[c], probs))


def test_quantiles_over_tasks_with_ties_nulls_and_a_hot_value(spark):
    rng = np.random.default_rng(1)
    n = 20_000
    pdf = pd.DataFrame({"hot": np.where(rng.random(n) < 0.4, 3.0, np.round(rng.normal(3, 1, n), 2)),
                        "far": rng.lognormal(0, 4, n), "few": rng.integers(0, 3, n).astype(float)})
    pdf.loc[rng.random(n) < 0.2, "far"] = None
    pdf.loc[rng.random(n) < 0.9995, "few"] = None
    df = spark.createDataFrame(pdf.replace({np.nan: None})).repartition(13).withColumn("none", F.lit(None).cast("double"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {r["feature"]: r for r in profile.quantiles(df, ["hot", "none", "far", "few"], probs).collect()}
    assert set(got) == set(pdf)
    for c in pdf:
        known = pdf[c].dropna()
        assert got[c]["n"] == len(known) and np.allclose(got[c]["q"], np.quantile(known, probs))
    assert profile.quantiles(df.limit(0), ["hot"], probs).count() == 0
    empty = profile.column_profile(df.limit(0), ["hot", "none"]).collect()
    assert [(r["n"], r["median"], r["rule"]) for r in empty] == [(0, None, "none")] * 2


def test_profile_evaluates_its_input_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    assert profile.column_profile(df.mapInArrow(count, "x double, y double"), ["x", "y"]).count() == 2
    assert seen.value == 2000


def test_profile_follows_pandas(spark, cohort):
    pdf = cohort.toPandas()
    got = {r["feature"]: r for r in profile.column_profile(cohort, ["Temp", "Creatinine", "pH"]).collect()}
    for c, r in got.items():
        assert r["skew"] == pytest.approx(pdf[c].skew())
        assert r["std"] == pytest.approx(pdf[c].std())
        assert r["q25"] == pytest.approx(pdf[c].quantile(0.25))
        assert r["rule"] == ("iqr" if abs(pdf[c].skew()) > 0.75 else "zscore")


def test_scaler_uses_population_sd_and_spares_constants(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(4)], "x double, c double")
    out = profile.standardize(df, ["x", "c"], profile.scaler(df, ["x", "c"])).toPandas()
    assert out["x"].std(ddof=0) == pytest.approx(1) and (out["c"] == 0).all()


def test_median_fill_and_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "x double, e double")
    assert [tuple(r) for r in profile.fill_median(df, ["x", "e", "absent"]).collect()] == [
        (1.0, 0.0, 0.0), (2.5, 0.0, 0.0), (4.0, 0.0, 0.0)]


def test_ranks_and_exact_samples(spark):
    df = spark.range(3000).withColumn("s", (F.col("id") % 10 == 0).cast("int"))
    ranks = ranking.hash_rank(df, "id", "t", ["s"]).groupBy("s").agg(
        F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("top")).collect()
    assert all(r["n"] == r["d"] == r["top"] for r in ranks)
    for n in (0, 1, 777, 3000, 5000):
        assert ranking.take_exact(df, n, "id", "t").count() == min(n, 3000)
    a = ranking.take_exact(df.repartition(7), 50, "id", "t").select("id")
    assert a.exceptAll(ranking.take_exact(df, 50, "id", "t").select("id")).isEmpty()


def test_metrics_fixture(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [0, 0, 1, 1, 0])), "y int, p int")
    got = metrics.binary_metrics(df, "y", "p").first().asDict()
    assert got == {"Accuracy": 0.8, "Precision": 1.0, "Recall": 0.6667, "F1 Score": 0.8}
    none = spark.createDataFrame([(0, 0)], "y int, p int")
    assert metrics.binary_metrics(none, "y", "p").first()["Precision"] == 0.0


def test_log_loss_of_a_sure_miss_is_finite(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.5)], "y int, p double")
    assert metrics.log_loss(df, "y", "p").first()[0] == pytest.approx((100 + math.log(2)) / 2)


def test_special_functions(spark):
    rows = spark.range(1, 60).select("id", special.digamma(F.col("id")).alias("d")).collect()
    for r in rows:
        assert r["d"] == pytest.approx(-0.5772156649015329 + sum(1 / i for i in range(1, r["id"])), abs=1e-10)
    for df, x in ((1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729)):
        assert special.chi2_tail(x, df) == pytest.approx(0.05, abs=1e-6)


def brute_mi(x, y, k=3):
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))
    keep = np.isin(y, [c for c in np.unique(y) if (y == c).sum() > 1])
    x, y, terms = x[keep], y[keep], []
    for i in range(len(x)):
        same = np.sort(np.abs(x[y == y[i]] - x[i]))
        kk = min(k, len(same) - 1)
        r, d = same[kk], np.abs(x - x[i])
        m = (d < r - 1e-12 * max(abs(x[i]), r)).sum() if r > 0 else (d == 0).sum()
        terms.append(psi(kk) - psi(len(same)) - psi(m))
    return max(0.0, psi(len(x)) + np.mean(terms))


@pytest.mark.parametrize("rows_per_block", [10 ** 6, 41])
def test_neighbour_information_by_brute_force(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(selection, "BLOCK_ROWS", rows_per_block)
    rng = np.random.default_rng(3)
    y = np.r_[np.zeros(150), np.ones(30), [2]].astype(int)
    pdf = pd.DataFrame({"y": y, "a": rng.normal(size=181) + y, "b": rng.integers(0, 6, 181).astype(float)})
    pdf.loc[pdf.index[:70], "b"] = 4.0  # one value holds a third of the rows
    got = {r["feature"]: r["mi"] for r in selection.mi_knn(spark.createDataFrame(pdf), ["a", "b"], "y").collect()}
    for c in ("a", "b"):
        assert got[c] == pytest.approx(brute_mi(pdf[c].to_numpy(), y), abs=1e-9)


def test_selector_keeps_canonical_order(spark, cohort):
    chooser = selection.TwoTierSelector(method="binned")
    out = chooser.fit(cohort.drop("row_id"), "SepsisLabel").transform(cohort, ["row_id"])
    assert chooser.selected == list(catalog.FEATURES) and out.columns == ["row_id", *catalog.FEATURES]


def test_draws_do_not_depend_on_layout(spark):
    one = spark.range(500).select("id", hashing.uniform("id", "s").alias("z"))
    two = spark.range(500).repartition(9).select("id", hashing.uniform("id", "s").alias("z"))
    assert one.exceptAll(two).isEmpty()
    assert abs(one.toPandas()["z"].mean() - 0.5) < 0.1


def test_links(spark):
    pages = spark.createDataFrame([('<a href="p000002.psv">x</a><a href="p000001.psv">',), ('<a href="p000001.psv">',), ("",)], "html string")
    assert [r["link"] for r in links.links(pages).collect()] == ["p000001.psv", "p000002.psv"]
