"""One query per operator, over the shared test tables.

There is no clinical data among those tables, so the ``events`` log stands in for it: a user is a
stay, an hour with events is a row, the event type and the number in ``props`` choose one of the
twenty measured channels, and a large purchase is the positive label.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit import catalog, session
from panelkit.catalog import LABEL, PanelSpec
from panelkit.functions import clinical
from panelkit.models import classical, stages
from panelkit.operators import (balance, explain, impute, metrics, panel, profile,
                                selection, split)
from panelkit.plans import evaluation, model
from panelkit.sources import generator, links, records

TYPES = ("click", "view", "error", "signup", "purchase")
SPEC = PanelSpec("user_id", "h", LABEL, catalog.MEASURED)
FEATURES = list(catalog.FEATURES)
MEASURED = list(catalog.MEASURED)
ROW = ["user_id", "h"]
DIMS = 64
EPOCH_HOURS = 438_288  # hours are counted from the start of 2020


def scale_of(channel: str) -> tuple[float, float]:
    """Event values (mean 50) land in a channel's normal range: ``lo + width * value / 100``."""
    if channel == "HR":
        return 60.0, 60.0
    if channel == "WBC":
        return 0.0, 20.0
    lo, hi = catalog.NORMAL_RANGE[channel]
    return lo, hi - lo


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events_panel(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    place = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")), F.lit(0))
    unknown = F.raise_error(F.concat(F.lit("unknown event type "), F.coalesce("event_type", F.lit("null"))))
    kind = F.when(place > 0, place.cast("int") - 1).otherwise(unknown.cast("int"))
    hours = table(spark, sf, "events").select(
        "user_id", (F.floor(F.unix_timestamp("ts") / 3600) - EPOCH_HOURS).cast("bigint").alias("h"),
        (kind * 4 + F.floor(k / 25)).alias("cell"), "value",
        ((F.col("event_type") == "purchase") & (F.col("value") >= 200)).alias("hit"))
    def channel(i, c):
        lo, width = scale_of(c)
        return F.max(F.when(F.col("cell") == i, F.lit(lo) + F.lit(width) * F.col("value") / 100.0)).alias(c)
    return hours.groupBy("user_id", "h").agg(
        *[channel(i, c) for i, c in enumerate(MEASURED)],
        F.max(F.when(F.col("hit"), 1).otherwise(0)).alias(LABEL))


def vectors(spark, sf) -> DataFrame:
    return panel.patient_vector(events_panel(spark, sf), SPEC)


def filled_vectors(spark, sf) -> DataFrame:
    """Patient vectors with defaults for what was never measured, clipped: no nulls."""
    return clinical.accept_record(vectors(spark, sf), None, ["user_id", LABEL])


def hourly_filled(spark, sf) -> DataFrame:
    cohort = panel.hourly_cohort(events_panel(spark, sf), SPEC)
    return cohort.select(F.concat_ws("-", *ROW).alias("row_id"), "user_id",
                         *[clinical.default_fill(f, f).alias(f) for f in FEATURES], LABEL)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else
                       F.col(c).cast("bigint").alias(c) if t in ("int", "boolean") else F.col(c)
                       for c, t in df.dtypes])


def _labelled(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")


def _embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


def _wide(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", *[F.col("embedding")[j].cast("double").alias(f"e{j}") for j in range(DIMS)])


WIDE = [f"e{j}" for j in range(DIMS)]


# --- panel -----------------------------------------------------------------------------------

def boundary(spark, sf):
    return rounded(panel.boundary(events_panel(spark, sf), SPEC))


def truncate_history(spark, sf):
    return rounded(panel.truncate_history(events_panel(spark, sf), SPEC))


def locf(spark, sf):
    return rounded(panel.locf(events_panel(spark, sf), SPEC))


def locf_bfill(spark, sf):
    return rounded(panel.locf(events_panel(spark, sf), SPEC, backfill=True))


def locf_blocks(spark, sf):
    """The same result when histories are cut into four-day blocks."""
    blocks = events_panel(spark, sf).withColumn("block", F.floor(F.col("h") / 96))
    spec = PanelSpec("user_id", "h", LABEL, catalog.MEASURED, "block")
    return rounded(panel.locf(blocks, spec, backfill=True).drop("block"))


def patient_vector(spark, sf):
    return rounded(vectors(spark, sf).select("user_id", *FEATURES, LABEL))


def hourly_cohort(spark, sf):
    return rounded(panel.hourly_cohort(events_panel(spark, sf), SPEC).select(*ROW, *FEATURES, LABEL))


def panel_extract(spark, sf):
    first = panel.first_entities(events_panel(spark, sf), SPEC, 20)
    absent = {f: F.lit(None).cast("double") for f in FEATURES if f not in MEASURED}
    return rounded(first.withColumns(absent).select("user_id", "Hour", *FEATURES, LABEL))


def sample_entities(spark, sf):
    return rounded(panel.sample_entities(events_panel(spark, sf), SPEC, 50).select(*ROW, LABEL))


def any_measured(spark, sf):
    return rounded(panel.measured_only(events_panel(spark, sf), MEASURED, 2))


def class_counts(spark, sf):
    return rounded(profile.class_counts(events_panel(spark, sf), LABEL))


# --- rows ------------------------------------------------------------------------------------

def sirs_score(spark, sf):
    return rounded(events_panel(spark, sf).select(*ROW, clinical.sirs_score().alias("SIRS")))


def sirs_if_any_null(spark, sf):
    given = events_panel(spark, sf).withColumn("SIRS", F.when(F.col("HR").isNull(), F.lit(3.0)))
    return rounded(clinical.with_sirs(given, "if_any_null").select(*ROW, "SIRS"))


def clip_limits(spark, sf):
    return rounded(clinical.clip_limits(events_panel(spark, sf)).drop(LABEL))


def default_and_clip(spark, sf):
    out = clinical.accept_record(vectors(spark, sf), None, ["user_id"])
    return rounded(out.withColumn("warnings", F.array_join("warnings", "|")))


def default_lower(spark, sf):
    return rounded(vectors(spark, sf).select(
        "user_id", *[clinical.default_fill(f, f, "lower").alias(f) for f in FEATURES]))


def feature_vector(spark, sf):
    return rounded(clinical.clip_limits(vectors(spark, sf)).select("user_id", *FEATURES))


def rule_score(spark, sf):
    p = clinical.rule_probability()
    return rounded(vectors(spark, sf).select(
        "user_id", p.alias("prob"), F.round(p, 3).alias("prediction_probability"),
        clinical.alert_level(p).alias("alert_level"), clinical.above(p, 0.30).alias("is_above_threshold")))


def rule_attributions(spark, sf):
    cells = vectors(spark, sf).select("user_id", F.explode(clinical.rule_attributions()).alias("a"))
    return rounded(cells.select("user_id", "a.*"))


def risk_band(spark, sf):
    scored = vectors(spark, sf).select("user_id", clinical.rule_probability().alias("prob"))
    bands = [c.alias(n) for n, c in clinical.risk_band("prob").items()]
    return rounded(scored.select("user_id", *bands, clinical.above(F.col("prob"), 0.5).alias("above_half")))


# --- statistics ------------------------------------------------------------------------------

def inject_missing(spark, sf):
    return rounded(generator.inject_missing(events_panel(spark, sf), ROW, MEASURED, 0.3).drop(LABEL))


def column_profile(spark, sf):
    return rounded(profile.column_profile(events_panel(spark, sf), MEASURED), 9)


def outlier_flags(spark, sf):
    flagged = profile.flag_outliers(events_panel(spark, sf), MEASURED)
    return rounded(flagged.select(*ROW, *[c + "_outlier" for c in MEASURED]))


def median_impute(spark, sf):
    return rounded(profile.fill_median(events_panel(spark, sf), MEASURED).drop(LABEL), 9)


def standard_scale(spark, sf):
    df = events_panel(spark, sf)
    return rounded(profile.standardize(df, MEASURED, profile.scaler(df, MEASURED)).drop(LABEL))


def gram_matrix(spark, sf):
    return rounded(impute.mean_products(filled_vectors(spark, sf), FEATURES))


# --- imputation ------------------------------------------------------------------------------

def mice_step(spark, sf):
    fit = impute.ChainedImputer(FEATURES, max_iter=1, sample_posterior=False, schedule="block")
    return fit.fit_transform(vectors(spark, sf).select("user_id", *FEATURES), "user_id")


def mice_sequential(spark, sf):
    fit = impute.ChainedImputer(FEATURES, max_iter=2, schedule="sequential")
    return fit.fit_transform(vectors(spark, sf).select("user_id", *FEATURES), "user_id")


# --- splits and balancing ----------------------------------------------------------------------

def holdout_split(spark, sf):
    return rounded(split.holdout(events_panel(spark, sf).select(*ROW, LABEL), ROW, LABEL))


def stratified_folds(spark, sf):
    return rounded(split.stratified_kfold(events_panel(spark, sf).select(*ROW, LABEL), ROW, LABEL))


def kfold(spark, sf):
    return rounded(split.kfold(events_panel(spark, sf).select(*ROW), ROW))


def group_folds(spark, sf):
    return rounded(split.group_fold_table(events_panel(spark, sf), "user_id", LABEL))


def fold_leak_check(spark, sf):
    folded = split.group_kfold(events_panel(spark, sf).select(*ROW, LABEL), "user_id", LABEL)
    leaks = split.leaking_groups(folded, "user_id").agg(F.count(F.lit(1)).alias("leaking"))
    per = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.sum(LABEL).alias("positives"))
    return rounded(per.withColumn("leaking", leaks.scalar()))


def balance_targets(spark, sf):
    sizes = balance.class_sizes(events_panel(spark, sf), LABEL)
    most = {"holdout": tuple(n * 4 // 5 for n in catalog.COHORT_TARGETS)}
    parts = [balance.targets(sizes, rule, most.get(rule, catalog.COHORT_TARGETS)).withColumn("rule", F.lit(rule))
             for rule in ("fold", "holdout", "final", "hourly_small")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def downsample_exact(spark, sf):
    zeros = events_panel(spark, sf).filter(F.col(LABEL) == 0).select(*ROW)
    return balance.downsample_exact(zeros, ROW, 1000)


def _positives(spark, sf):
    return hourly_filled(spark, sf).filter(F.col(LABEL) == 1).select("row_id", *FEATURES)


def replicate_up(spark, sf):
    return rounded(balance.replicate_up(_positives(spark, sf), "row_id", FEATURES, 2000))


def interpolate_pairs(spark, sf):
    return rounded(balance.interpolate_pairs(_positives(spark, sf), "row_id", FEATURES, 2000))


def cluster_undersample(spark, sf):
    zeros = hourly_filled(spark, sf).filter(F.col(LABEL) == 0)
    return balance.cluster_centroids(zeros, "row_id", FEATURES, 50)


def smote(spark, sf):
    minority = _wide(_embeddings(spark, sf).filter(F.col("label") == 3))
    made = balance.smote(minority, "vec_id", WIDE, 500)
    return rounded(profile.melt(made, WIDE, ["vec_id"]))


def balance_classes(spark, sf):
    df = _wide(_embeddings(spark, sf)).withColumn("label", (F.col("label") < 2).cast("int"))
    out = balance.balance(df, "vec_id", "label", WIDE, 300, 250)
    return rounded(profile.melt(out, WIDE, ["vec_id", "label"]).withColumn("label", F.col("label").cast("bigint")))


def balance_hourly(spark, sf):
    return balance.balance(hourly_filled(spark, sf), "row_id", LABEL, FEATURES, 60, 50, majority="centroids")


# --- neighbours and models -----------------------------------------------------------------------

def _parts(spark, sf):
    tagged = split.holdout(_embeddings(spark, sf), "vec_id", "label")
    return tagged.filter("not is_test"), tagged.filter("is_test")


def knn_classify(spark, sf):
    train, test = (_wide(p) for p in _parts(spark, sf))
    return rounded(classical.knn_classify(train, test, WIDE, "label", "vec_id"))


def gaussian_nb(spark, sf):
    train, test = _parts(spark, sf)
    return rounded(classical.gaussian_nb(train, test, "embedding", "label", "vec_id"))


def recon_mse(spark, sf):
    coarse = _embeddings(spark, sf).withColumn(
        "rebuilt", F.transform("embedding", lambda x: F.floor(x.cast("double") * 10.0) / 10.0))
    return rounded(metrics.reconstruction_mse(coarse, "embedding", "rebuilt"))


def _latent_model(spark, sf):
    return model.LatentModel.fit(filled_vectors(spark, sf), "user_id", LABEL, max_iter=20)


def pca_latent(spark, sf):
    return _latent_model(spark, sf).latents(filled_vectors(spark, sf), ["user_id"])


def pca_variance(spark, sf):
    """Whether the latent dimensions are uncorrelated, and in order of falling variance."""
    latent = pca_latent(spark, sf)
    names = latent.columns[1:]
    spread = latent.agg(*[F.var_pop(n).alias(n) for n in names],
                        *[F.covar_pop(a, b).alias(f"{a}:{b}") for i, a in enumerate(names) for b in names[:i]])
    off = F.greatest(*[F.abs(f"{a}:{b}") for i, a in enumerate(names) for b in names[:i]])
    falling = [F.col(a) >= F.col(b) - 1e-9 for a, b in zip(names, names[1:])]
    ordered = falling[0]
    for f in falling[1:]:
        ordered = ordered & f
    return rounded(spread.select(F.lit(len(names)).alias("dimensions"), (off < 1e-6).alias("uncorrelated"),
                                 ordered.alias("ordered")))


def mlp_score(spark, sf):
    fitted = model.RecordModel.fit(filled_vectors(spark, sf), "user_id", LABEL, max_iter=20)
    values = F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f).cast("string"))])
    scored = fitted.score_records(vectors(spark, sf).select("user_id", values.alias("vitals")), ["user_id"])
    return scored.select("user_id", "prediction_probability", "alert_level", "is_above_threshold")


def ml_pipeline(spark, sf):
    """Imputation to classifier as one estimator, fitted on all vectors and applied to them."""
    rows = vectors(spark, sf).persist()
    fitted = stages.training_pipeline("user_id").fit(rows)
    return fitted.transform(rows).select("user_id", LABEL, vector_to_array("probability")[1].alias("prob"))


def score_latent(spark, sf):
    out = _latent_model(spark, sf).explain(vectors(spark, sf), "user_id")
    return out.select("user_id", "sepsis_probability", "alert_level", "is_sepsis_onset_6h",
                      F.to_json("shap_waterfall").alias("shap_waterfall"))


def cv_leakfree(spark, sf):
    return evaluation.leakage_free_cv(
        vectors(spark, sf).select("user_id", *FEATURES, LABEL), "user_id", group="user_id", k=2, max_iter=20, sweeps=1)


def cv_balanced(spark, sf):
    return evaluation.balanced_cv(filled_vectors(spark, sf), "user_id", k=2, max_iter=20)


def baseline_table(spark, sf):
    return evaluation.comparison_table(vectors(spark, sf).select("user_id", *FEATURES, LABEL), "user_id")


# --- selection and metrics -----------------------------------------------------------------------

def chi2_scores(spark, sf):
    scores = selection.chi2_scores(_labelled(spark, sf), ["toxic", "n_chars"], "quality")
    return rounded(scores.select("feature", "statistic", "df", (F.col("p_value") < 0.05).alias("significant")))


def mi_binned(spark, sf):
    return rounded(selection.mi_binned(_labelled(spark, sf), ["n_chars", "toxic"], "quality"))


def mi_knn(spark, sf):
    return rounded(selection.mi_knn(_labelled(spark, sf), ["n_chars"], "quality"))


def select_features(spark, sf):
    df = vectors(spark, sf)
    chooser = selection.TwoTierSelector()
    kept = chooser.kept(chooser.scores(df, LABEL, [*MEASURED, "SIRS"]))
    return rounded(kept.select("feature", "kind", "score", "rank"))


def binary_metrics(spark, sf):
    return metrics.binary_metrics(table(spark, sf, "labels"), "quality", "toxic")


def log_loss(spark, sf):
    scored = vectors(spark, sf).select(LABEL, clinical.rule_probability().alias("prob"))
    return rounded(metrics.log_loss(scored, LABEL, "prob"))


def fold_summary(spark, sf):
    folded = split.stratified_kfold(table(spark, sf, "labels"), "doc_id", "quality")
    return metrics.fold_summary(metrics.binary_metrics(folded, "quality", "toxic", ["fold"]), "fold")


# --- explanations ---------------------------------------------------------------------------------

def background_sample(spark, sf):
    return rounded(explain.background(filled_vectors(spark, sf), "user_id").select("user_id", *catalog.BOTTLENECK))


def _attributed(spark, sf):
    df = filled_vectors(spark, sf)
    return explain.attributions(df, catalog.BOTTLENECK, clinical.rule_probability, explain.background(df, "user_id"),
                                used=clinical.RULE_DEFAULTS)


def perturb_shap(spark, sf):
    cells = _attributed(spark, sf).select("user_id", F.posexplode_outer("attributions").alias("at", "phi"))
    names = F.array(*[F.lit(f) for f in catalog.BOTTLENECK])
    return rounded(cells.select("user_id", F.get(names, F.col("at")).alias("feature"), "phi"))


def waterfall(spark, sf):
    bars = _attributed(spark, sf).select("user_id", F.posexplode(explain.waterfall(catalog.BOTTLENECK)).alias("place", "w"))
    return rounded(bars.select("user_id", "place", "w.*"))


def waterfall_top3(spark, sf):
    bars = _attributed(spark, sf).withColumn("w", explain.waterfall(catalog.BOTTLENECK))
    return bars.select("user_id", *[F.array_join(explain.top_factors("w", i), ",").alias(i)
                                    for i in ("contributing", "offsetting")])


def global_importance(spark, sf):
    return rounded(explain.global_importance(_attributed(spark, sf), catalog.BOTTLENECK))


def _heatmap_cells(spark, sf):
    long = profile.melt(filled_vectors(spark, sf), FEATURES, ["user_id"])
    layers = F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(float(i)).alias("w"))
                       for i, n in enumerate(catalog.HEATMAP_LAYERS, 1)])
    cells = long.withColumn("l", F.explode(layers))
    return cells.select("user_id", "l.layer", "feature", (F.abs("value") / F.col("l.w")).alias("value"))


def dhm_scores(spark, sf):
    return rounded(explain.discounted_scores(_heatmap_cells(spark, sf), ["user_id"]))


def dhm_rank(spark, sf):
    scores = explain.discounted_scores(_heatmap_cells(spark, sf), ["user_id"])
    return rounded(explain.rank_features(scores, ["user_id"], 11).select("user_id", "feature", "rank"))


# --- scoring and sources ---------------------------------------------------------------------------

def score_records(spark, sf):
    values = F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f).cast("string"))])
    sent = vectors(spark, sf).select("user_id", values.alias("vitals"))
    accepted = records.from_map(sent, "vitals", ["user_id"]).withColumn("prob", clinical.rule_probability())
    reference = explain.background(filled_vectors(spark, sf), "user_id")
    explained = explain.attributions(accepted, catalog.BOTTLENECK, clinical.rule_probability, reference,
                                     used=clinical.RULE_DEFAULTS)
    out = model.scored_records(explained, ["user_id"])
    return rounded(out.withColumns({
        "n_warnings": F.size("warnings"), "top_feature": F.col("shap_waterfall")[0]["feature"],
        "top_value": F.col("shap_waterfall")[0]["patient_value"],
        "top_shap": F.col("shap_waterfall")[0]["shap_value"]}).drop(
        "warnings", "shap_waterfall", "model_architecture", "disclaimer"))


def score_json(spark, sf):
    body = F.regexp_replace("props", '"k"', '"Temp"')
    sent = records.from_json(table(spark, sf, "events").withColumn("body", body), "body", None)
    accepted = records.from_map(sent, "vitals", ["event_id"])
    p = clinical.rule_probability()
    return rounded(accepted.select("event_id", "Temp", p.alias("prob"), F.size("warnings").alias("n_warnings"),
                                   F.get("warnings", F.lit(1)).alias("second_warning")))


def page_links(spark, sf):
    return links.links(table(spark, sf, "pages"), pattern=r'href="/([^"]*)"')


def catalog_midpoints(spark, sf):
    cells = profile.melt(events_panel(spark, sf), catalog.RAW, ROW).filter(F.col("value").isNotNull())
    joined = cells.join(F.broadcast(catalog.catalogue(spark)), "feature")
    within = F.col("value").between(F.col("normal_lo"), F.col("normal_hi"))
    return rounded(joined.groupBy("feature", "ord", "is_bottleneck", "is_top", "normal_lo", "normal_hi",
                                  "lim_lo", "lim_hi", "midpoint").agg(
        F.count(F.lit(1)).alias("measured"), F.count(F.when(within, 1)).alias("normal")))


QUERIES = [
    boundary, truncate_history, locf, locf_bfill, locf_blocks, patient_vector, hourly_cohort,
    panel_extract, sample_entities, any_measured, class_counts,
    sirs_score, sirs_if_any_null, clip_limits, default_and_clip, default_lower, feature_vector,
    rule_score, rule_attributions, risk_band,
    inject_missing, column_profile, outlier_flags, median_impute, standard_scale, gram_matrix,
    mice_step, mice_sequential,
    holdout_split, stratified_folds, kfold, group_folds, fold_leak_check, balance_targets,
    downsample_exact, replicate_up, interpolate_pairs, cluster_undersample, smote, balance_classes,
    balance_hourly,
    knn_classify, gaussian_nb, recon_mse, pca_latent, pca_variance, mlp_score, ml_pipeline, score_latent, cv_leakfree,
    cv_balanced, baseline_table,
    chi2_scores, mi_binned, mi_knn, select_features, binary_metrics, log_loss, fold_summary,
    background_sample, perturb_shap, waterfall, waterfall_top3, global_importance, dhm_scores, dhm_rank,
    score_records, score_json, page_links, catalog_midpoints,
]


def _tuned(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(session.tune(spark), sf_dir)
    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries():
    return {q.__name__: _tuned(q) for q in QUERIES}
