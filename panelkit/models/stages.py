"""The preparation steps and models as ``pyspark.ml`` stages.

They stand in a ``Pipeline`` beside Spark's own, go through ``CrossValidator`` and ``TrainValidationSplit``, and are
saved and loaded with the pipeline that holds them. A fitted stage keeps its arrays in a small Parquet table beside
its parameters.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasInputCol, HasInputCols, HasLabelCol, HasMaxIter, HasOutputCol,
                                     HasSeed)
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit import catalog
from panelkit.functions import clinical
from panelkit.operators import impute, selection
from panelkit.sources import artifacts


class _FittedWriter(MLWriter):
    def __init__(self, instance: "_Fitted"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.instance, path, spark, extraMetadata={"fitted": self.instance._facts()})
        artifacts.save(spark, f"{path}/arrays", self.instance._arrays())


class _FittedReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> "_Fitted":
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        instance = self.cls()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        instance._restore(metadata["fitted"], artifacts.load(spark, f"{path}/arrays"))
        return instance


class _Fitted(Model, MLReadable, MLWritable):
    """A model whose fitted state is a few named arrays and a JSON object of facts."""

    def write(self) -> MLWriter:
        return _FittedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FittedReader(cls)

    def _facts(self) -> dict:
        return {}

    def _arrays(self) -> Mapping[str, np.ndarray]:
        return {}

    def _restore(self, facts: dict, arrays: Mapping[str, np.ndarray]) -> None:
        raise NotImplementedError


class _ImputerParams(HasInputCols, HasMaxIter, HasSeed):
    keyCol = Param(Params._dummy(), "keyCol", "column that identifies a row; draws depend on it", TypeConverters.toString)
    samplePosterior = Param(Params._dummy(), "samplePosterior", "draw from the posterior instead of its mean",
                            TypeConverters.toBoolean)
    schedule = Param(Params._dummy(), "schedule", "block: one job a sweep; sequential: one for each column",
                     TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(maxIter=10, seed=42, samplePosterior=True, schedule="block", inputCols=list(catalog.FEATURES))


class PanelImputer(Estimator, _ImputerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Chained-equation imputation of ``inputCols`` in place."""

    @keyword_only
    def __init__(self, *, keyCol: str | None = None, inputCols: Sequence[str] | None = None, maxIter: int = 10,
                 seed: int = 42, samplePosterior: bool = True, schedule: str = "block"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PanelImputerModel":
        get = self.getOrDefault
        fitted = impute.ChainedImputer(get("inputCols"), get("maxIter"), get("seed"), get("samplePosterior"),
                                       get("schedule")).fit(dataset, get("keyCol"))
        return self._copyValues(PanelImputerModel(fitted))


class PanelImputerModel(_Fitted, _ImputerParams):
    def __init__(self, fitted: impute.ChainedImputer | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset, self.getOrDefault("keyCol"))

    def _facts(self) -> dict:
        return {"seed": self.fitted.seed}

    def _arrays(self) -> Mapping[str, np.ndarray]:
        return self.fitted.to_arrays()

    def _restore(self, facts: dict, arrays: Mapping[str, np.ndarray]) -> None:
        self.fitted = impute.ChainedImputer.from_arrays(arrays, facts["seed"])


class LimitClipper(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Known columns among ``inputCols`` clamped to the catalogue's permissible limits."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None):
        super().__init__()
        self._setDefault(inputCols=list(catalog.FEATURES))
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clinical.clip_limits(dataset, columns=self.getOrDefault("inputCols"))


class _SelectorParams(HasInputCols, HasLabelCol, HasOutputCol):
    nContinuous = Param(Params._dummy(), "nContinuous", "continuous features to keep", TypeConverters.toInt)
    categorical = Param(Params._dummy(), "categorical", "categorical candidates, of which the best one stays",
                        TypeConverters.toListString)
    alpha = Param(Params._dummy(), "alpha", "largest p-value of a kept categorical feature", TypeConverters.toFloat)
    method = Param(Params._dummy(), "method", "knn or binned mutual information", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(nContinuous=18, categorical=["SIRS", "Gender"], alpha=0.05, method="knn",
                         inputCols=list(catalog.FEATURES), labelCol=catalog.LABEL, outputCol="selected")


class FeatureSelector(Estimator, _SelectorParams, DefaultParamsReadable, DefaultParamsWritable):
    """The two-tier selection; the kept features become the vector ``outputCol``."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, labelCol: str = catalog.LABEL,
                 outputCol: str = "selected", nContinuous: int = 18, categorical: Sequence[str] | None = None,
                 alpha: float = 0.05, method: str = "knn"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "FeatureSelectorModel":
        get = self.getOrDefault
        fitted = selection.TwoTierSelector(get("nContinuous"), get("categorical"), get("alpha"), get("method")).fit(
            dataset, get("labelCol"), get("inputCols"))
        if not fitted.selected:
            raise ValueError("no feature was selected")
        return self._copyValues(FeatureSelectorModel(fitted.selected, fitted.mi_scores, fitted.chi2))


class FeatureSelectorModel(_Fitted, _SelectorParams):
    def __init__(self, selected: Sequence[str] = (), mi_scores: Mapping | None = None, chi2: Mapping | None = None):
        super().__init__()
        self.selected, self.mi_scores, self.chi2 = list(selected), dict(mi_scores or {}), dict(chi2 or {})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.selected, outputCol=self.getOrDefault("outputCol")).transform(dataset)

    def _facts(self) -> dict:
        return json.loads(json.dumps({"selected": self.selected, "mi_scores": self.mi_scores, "chi2": self.chi2}))

    def _restore(self, facts: dict, arrays: Mapping[str, np.ndarray]) -> None:
        self.selected, self.mi_scores, self.chi2 = facts["selected"], facts["mi_scores"], facts["chi2"]


class LatentReducer(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A standardised vector on its first ``k`` principal components, or as many as it has entries.

    The model is Spark's own scaler and components, as a pipeline.
    """

    k = Param(Params._dummy(), "k", "components", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "selected", outputCol: str = "latent", k: int = 11):
        super().__init__()
        self._setDefault(inputCol="selected", outputCol="latent", k=11)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        source, target = self.getOrDefault("inputCol"), self.getOrDefault("outputCol")
        wide = _size(dataset, source)
        scaled = f"{target}_scaled"
        return Pipeline(stages=[
            StandardScaler(inputCol=source, outputCol=scaled, withMean=True, withStd=True),
            PCA(inputCol=scaled, outputCol=target, k=min(self.getOrDefault("k"), wide))]).fit(dataset)


class PerceptronClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, DefaultParamsReadable,
                           DefaultParamsWritable):
    """Spark's perceptron with the input layer as wide as the features and two outputs."""

    hidden = Param(Params._dummy(), "hidden", "sizes of the hidden layers", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, featuresCol: str = "latent", labelCol: str = catalog.LABEL,
                 hidden: Sequence[int] | None = None, maxIter: int = 100, seed: int = 42):
        super().__init__()
        self._setDefault(featuresCol="latent", labelCol=catalog.LABEL, hidden=[128, 64, 32], maxIter=100, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        get = self.getOrDefault
        return MultilayerPerceptronClassifier(
            layers=[_size(dataset, get("featuresCol")), *get("hidden"), 2], featuresCol=get("featuresCol"),
            labelCol=get("labelCol"), maxIter=get("maxIter"), seed=get("seed")).fit(dataset)


def _size(dataset: DataFrame, column: str) -> int:
    first = dataset.select(F.size(vector_to_array(column)).alias("n")).first()
    if first is None:
        raise ValueError("no rows to fit")
    return first["n"]


def training_pipeline(key: str, label: str = catalog.LABEL, features: Sequence[str] = catalog.FEATURES, k: int = 11,
                      hidden: Sequence[int] = (128, 64, 32), sweeps: int = 10, max_iter: int = 100, seed: int = 42,
                      method: str = "knn") -> Pipeline:
    """Imputation, limits, selection, reduction and classifier as one estimator; its model is saved in one call."""
    return Pipeline(stages=[
        PanelImputer(keyCol=key, inputCols=list(features), maxIter=sweeps, seed=seed),
        LimitClipper(inputCols=list(features)),
        FeatureSelector(inputCols=list(features), labelCol=label, method=method), LatentReducer(k=k),
        PerceptronClassifier(labelCol=label, hidden=list(hidden), maxIter=max_iter, seed=seed)])
