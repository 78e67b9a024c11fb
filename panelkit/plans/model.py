"""The trained models end to end: scale, reduce, classify, explain; and their two scoring paths.

Fitting is ``pyspark.ml``'s; fitted models are a few arrays, applied as Column arithmetic to batches and streams.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit import catalog
from panelkit.functions import clinical
from panelkit.models.perceptron import Components, Perceptron
from panelkit.operators import explain, profile
from panelkit.sources import artifacts

DIMENSIONS = 11
DISCLAIMER = "For research and decision support only; not a clinical diagnosis and no basis for automated decisions."


def latent_names(k: int) -> list[str]:
    return [f"latent_{i}" for i in range(k)]


def _scaler_arrays(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    fitted = {r["feature"]: r for r in profile.scaler(df, features).collect()}
    return (np.array([fitted[f]["mean"] for f in features]), np.array([fitted[f]["scale"] for f in features]))


def _matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    return df.select(*columns).toPandas().to_numpy("float64")


@dataclass
class LatentModel:
    """Principal components of all scaled features, and a perceptron on them."""

    features: list
    mean: np.ndarray
    scale: np.ndarray
    components: Components
    classifier: Perceptron
    background: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, key: str, label: str, features: Sequence[str] = catalog.FEATURES,
            k: int = DIMENSIONS, hidden: Sequence[int] = (8,), max_iter: int = 100, seed: int = 42,
            background_rows: int = explain.BACKGROUND_ROWS) -> LatentModel:
        features = list(features)
        df = df.select(key, label, *features).persist(StorageLevel.MEMORY_AND_DISK)
        model = cls(features, *_scaler_arrays(df, features), None, None, None)
        data = df.select(key, label, *[c.alias(f) for f, c in zip(features, model._scaled())])
        model.components = Components.fit(data, features, min(k, len(features)))
        latent = model.latents(df, [key, label])
        names = latent_names(model.components.matrix.shape[1])
        model.classifier = Perceptron.fit(latent, names, label, hidden, max_iter, seed)
        model.background = _matrix(explain.background(latent, key, background_rows, seed), names)
        df.unpersist()
        return model

    def _scaled(self) -> list[Column]:
        return [(F.col(f) - float(m)) / float(s) for f, m, s in zip(self.features, self.mean, self.scale)]

    def latents(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        columns = self.components.latents(self._scaled())
        return df.select(*keep, *[c.alias(n) for n, c in zip(latent_names(len(columns)), columns)])

    def probabilities(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` columns plus ``prob``."""
        latent = self.latents(df, keep)
        names = [c for c in latent.columns if c not in keep]
        return latent.select(*keep, self.classifier.score([F.col(n) for n in names]).alias("prob"))

    def explain(self, df: DataFrame, key: str, method: str | None = None) -> DataFrame:
        """Score records and say why: band, latent vector, waterfall.

        Missing features take the lower bound of their normal range. Attributions are of the latent dimensions
        and named so. ``method`` is "perturbation" or "gradient"; unless given, wide classifiers take gradients.
        """
        filled = df.select(key, *[clinical.default_fill(
            F.col(f) if f in df.columns else F.lit(None), f, "lower").alias(f) for f in self.features])
        names = latent_names(self.components.matrix.shape[1])
        latent = self.latents(filled, [key])

        def score(values: Mapping[str, Column]) -> Column:
            return self.classifier.probability([values[n] for n in names])

        own = [F.col(n) for n in names]
        scored = latent.withColumn("prob", self.classifier.score(own))
        if _by_gradient(self.classifier, method):
            out = scored.withColumn("attributions", self.classifier.expected_gradients(own, self.background))
        else:
            out = explain.attributions(scored, names, score, self.background)
        return out.select(
            key, F.round("prob", 4).alias("sepsis_probability"),
            clinical.alert_level(F.col("prob")).alias("alert_level"),
            (F.col("prob") >= catalog.DECISION_THRESHOLD).alias("is_sepsis_onset_6h"),
            F.lit(catalog.DECISION_THRESHOLD).alias("decision_threshold"),
            F.array(*[F.round(n, 4) for n in names]).alias("latent_representation"),
            explain.waterfall(names).alias("shap_waterfall"))

    def save(self, spark: SparkSession, path: str) -> None:
        artifacts.save(spark, path, {
            "mean": self.mean, "scale": self.scale, "components": self.components.matrix,
            "layers": np.array(self.classifier.layers), "classifier": self.classifier.weights,
            "background": self.background} | {f"feature:{f}": np.array([i]) for i, f in enumerate(self.features)})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LatentModel:
        a = artifacts.load(spark, path)
        features = sorted((n for n in a if n.startswith("feature:")), key=lambda n: a[n][0])
        return cls([f.partition(":")[2] for f in features], a["mean"], a["scale"], Components(a["components"]),
                   Perceptron([int(n) for n in a["layers"]], a["classifier"]), a["background"])


@dataclass
class RecordModel:
    """The service path: a classifier straight on the eleven raw bottleneck features.

    Without a classifier, as when none was fitted yet, the bedside rule scores.
    """

    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(catalog.BOTTLENECK)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(catalog.BOTTLENECK)))
    classifier: Perceptron | None = None
    background: np.ndarray = field(default_factory=lambda: np.zeros((1, len(catalog.BOTTLENECK))))

    @classmethod
    def fit(cls, df: DataFrame, key: str, label: str, hidden: Sequence[int] = (8,), max_iter: int = 100,
            seed: int = 42, background_rows: int = explain.BACKGROUND_ROWS) -> RecordModel:
        names = list(catalog.BOTTLENECK)
        df = df.select(key, label, *names).persist(StorageLevel.MEMORY_AND_DISK)
        mean, scale = _scaler_arrays(df, names)
        data = df.select(label, *[((F.col(f) - float(m)) / float(s)).alias(f) for f, m, s in zip(names, mean, scale)])
        fitted = cls(mean, scale, Perceptron.fit(data, names, label, hidden, max_iter, seed),
                     _matrix(explain.background(df, key, background_rows, seed), names))
        df.unpersist()
        return fitted

    def _scaled(self, values: Mapping[str, Column]) -> list[Column]:
        return [(values[f] - float(m)) / float(s) for f, m, s in zip(catalog.BOTTLENECK, self.mean, self.scale)]

    def score(self, values: Mapping[str, Column]) -> Column:
        """Probability as a function of the features' columns."""
        if self.classifier is None:
            return clinical.rule_probability(values)
        return self.classifier.probability(self._scaled(values))

    @property
    def architecture(self) -> str:
        """What scores, in a few words."""
        if self.classifier is None:
            return "bedside rule"
        return "perceptron " + " -> ".join(str(n) for n in self.classifier.layers)

    def score_records(self, df: DataFrame, keep: Sequence[str], vitals: str = "vitals",
                      method: str | None = None) -> DataFrame:
        """Score a map of vitals per record: checks, probability, band, wording, waterfall.

        ``method`` is "perturbation" or "gradient"; unless given, wide classifiers take gradients. The rule has
        none and is always perturbed.
        """
        accepted = clinical.accept_record(df, {f: F.col(vitals)[f] for f in catalog.FEATURES}, keep)
        own = {f: F.col(f) for f in catalog.BOTTLENECK}
        if self.classifier is None:
            explained = explain.attributions(accepted.withColumn("prob", self.score(own)), catalog.BOTTLENECK,
                                             self.score, self.background, used=clinical.RULE_DEFAULTS)
        else:
            scored = accepted.withColumn("prob", self.classifier.score(self._scaled(own)))
            if _by_gradient(self.classifier, method):
                background = (self.background - self.mean) / self.scale
                explained = scored.withColumn("attributions", self.classifier.expected_gradients(
                    self._scaled(own), background))
            else:
                explained = explain.attributions(scored, catalog.BOTTLENECK, self.score, self.background)
        return scored_records(explained, keep, self.architecture)

    def save(self, spark: SparkSession, path: str) -> None:
        fitted = {} if self.classifier is None else {
            "layers": np.array(self.classifier.layers), "classifier": self.classifier.weights}
        artifacts.save(spark, path, {"mean": self.mean, "scale": self.scale, "background": self.background} | fitted)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RecordModel:
        a = artifacts.load(spark, path)
        known = Perceptron([int(n) for n in a["layers"]], a["classifier"]) if "classifier" in a else None
        return cls(a["mean"], a["scale"], known, a["background"])


def _by_gradient(classifier: Perceptron, method: str | None) -> bool:
    if method not in (None, "perturbation", "gradient"):
        raise ValueError(f"no attribution method {method!r}")
    if method == "perturbation" and classifier.wide:
        raise ValueError("a wide classifier has no expression to perturb")
    return method == "gradient" or classifier.wide


def scored_records(df: DataFrame, keep: Sequence[str], architecture: str = "bedside rule") -> DataFrame:
    """Shape rows with ``prob``, ``warnings`` and ``attributions`` into score records."""
    band = clinical.risk_band("prob")
    values = {f: F.col(f) for f in catalog.BOTTLENECK}
    return df.select(
        *keep, F.round("prob", 4).alias("prediction_probability"),
        *[c.alias(n) for n, c in band.items()],
        F.lit(catalog.DECISION_THRESHOLD).alias("decision_threshold"), "warnings",
        explain.waterfall(catalog.BOTTLENECK, values=values).alias("shap_waterfall"),
        F.lit(architecture).alias("model_architecture"), F.lit(DISCLAIMER).alias("disclaimer"))
