"""Small perceptrons and principal components, fitted by ``pyspark.ml`` and applied as Column arithmetic.

A fitted model is a few numbers. As an expression it scores batches and streams inside generated code, and the
attributions of ``operators.explain`` can perturb its inputs without a Python worker. Expressions grow with the
number of weights, so perceptrons of more than ``COLUMN_WEIGHTS`` score in Arrow batches instead, and are explained by
expected gradients.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

COLUMN_WEIGHTS = 2000
POINTS = 16  # places on each path of an expected gradient
PATHS = 8192  # paths that a task holds at a time


def _vectors(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol="_vec").transform(df)


def _weighted(weights: Sequence[float], inputs: Sequence[Column], bias: float = 0.0) -> Column:
    total = F.lit(float(bias))
    for w, x in zip(weights, inputs):
        total = total + F.lit(float(w)) * x
    return total


@dataclass
class Perceptron:
    """A two-class perceptron with sigmoid hidden layers: layer sizes and weights as ``pyspark.ml`` lays them out."""

    layers: list
    weights: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, inputs: Sequence[str], label: str, hidden: Sequence[int] = (8,),
            max_iter: int = 100, seed: int = 42) -> Perceptron:
        layers = [len(inputs), *hidden, 2]
        machine = MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed, featuresCol="_vec",
                                                 labelCol=label)
        return cls(layers, machine.fit(_vectors(df, inputs)).weights.toArray())

    def probability(self, inputs: Sequence[Column]) -> Column:
        """Probability of class 1."""
        values, at = list(inputs), 0
        for depth, (wide, tall) in enumerate(zip(self.layers, self.layers[1:])):
            matrix = self.weights[at:at + wide * tall].reshape(wide, tall).T
            bias = self.weights[at + wide * tall:at + (wide + 1) * tall]
            at += (wide + 1) * tall
            if depth == len(self.layers) - 2:
                # Two soft-maxed outputs are the logistic of their difference.
                against = _weighted(matrix[0] - matrix[1], values, bias[0] - bias[1])
                return F.lit(1.0) / (F.lit(1.0) + F.exp(against))
            values = [F.lit(1.0) / (F.lit(1.0) + F.exp(-_weighted(row, values, b))) for row, b in zip(matrix, bias)]


    @property
    def wide(self) -> bool:
        """Whether it has more weights than an expression should have."""
        return len(self.weights) > COLUMN_WEIGHTS

    def _steps(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(matrix, bias) of each layer; the last one gives the log-odds of class 1."""
        steps, at = [], 0
        for wide, tall in zip(self.layers, self.layers[1:]):
            steps.append((self.weights[at:at + wide * tall].reshape(wide, tall),
                          self.weights[at + wide * tall:at + (wide + 1) * tall]))
            at += (wide + 1) * tall
        matrix, bias = steps[-1]
        steps[-1] = (matrix[:, 1:] - matrix[:, :1], bias[1:] - bias[:1])
        return steps

    def batch_probability(self, inputs: Sequence[Column], batch_size: int = 4096) -> Column:
        """Probability of class 1 in Arrow batches, whatever the width; a null input gives NaN."""
        steps = self._steps()

        def load():
            def predict(x: np.ndarray) -> np.ndarray:
                return _forward(steps, np.asarray(x, "float64"))[-1][:, 0]
            return predict

        scorer = predict_batch_udf(load, return_type=DoubleType(), batch_size=batch_size,
                                   input_tensor_shapes=[[self.layers[0]]])
        return scorer(_numbers(inputs))

    def score(self, inputs: Sequence[Column]) -> Column:
        """Probability of class 1: Column arithmetic for small layers, batches for wide ones."""
        return self.batch_probability(inputs) if self.wide else self.probability(inputs)

    def expected_gradients(self, inputs: Sequence[Column], background: np.ndarray, points: int = POINTS) -> Column:
        """Attributions of the probability by gradients along straight paths from every row of ``background``.

        An input's attribution is the mean over the background of its distance times its derivative averaged over
        the path (Gauss-Legendre at ``points`` places), so attributions add up to the row's probability minus
        the background's mean. An empty background gives null; a null input gives NaN.
        """
        steps, background = self._steps(), np.asarray(background, "float64").reshape(-1, self.layers[0])
        if not len(background):
            return F.lit(None).cast("array<double>")
        places, shares = np.polynomial.legendre.leggauss(points)
        places, shares = (places + 1) / 2, shares / 2
        rows = max(1, PATHS // len(background))

        @F.pandas_udf("array<double>")
        def attribute(values: pd.Series) -> pd.Series:
            x, out = np.array(values.to_list(), "float64").reshape(-1, background.shape[1]), []
            for at in range(0, len(x), rows):
                block = x[at:at + rows]
                total = np.zeros_like(block)
                for low in range(0, len(background), PATHS):
                    start = background[None, low:low + PATHS]
                    away = block[:, None] - start
                    for place, share in zip(places, shares):
                        on_path = (start + place * away).reshape(-1, x.shape[1])
                        total += share * (_gradient(steps, on_path).reshape(away.shape) * away).sum(axis=1)
                out.extend(total / len(background))
            return pd.Series(out, dtype=object)

        return attribute(_numbers(inputs))


def _numbers(inputs: Sequence[Column]) -> Column:
    return F.array(*[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in inputs])


def _forward(steps, x: np.ndarray) -> list[np.ndarray]:
    """The input and the values of each layer."""
    layers = [x]
    for matrix, bias in steps:
        layers.append(1.0 / (1.0 + np.exp(-np.clip(layers[-1] @ matrix + bias, -700, 700))))
    return layers


def _gradient(steps, x: np.ndarray) -> np.ndarray:
    """Derivatives of the last value by the inputs, by the chain rule."""
    layers = _forward(steps, x)
    slope = layers[-1] * (1 - layers[-1])
    for depth in range(len(steps) - 1, -1, -1):
        slope = slope @ steps[depth][0].T
        if depth:
            slope = slope * layers[depth] * (1 - layers[depth])
    return slope


@dataclass
class Components:
    """Principal components: one column of weights for each latent dimension."""

    matrix: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, inputs: Sequence[str], k: int) -> Components:
        model = PCA(k=k, inputCol="_vec", outputCol="_latent").fit(_vectors(df, inputs))
        matrix = model.pc.toArray()
        # The sign of a component is free: its largest weight is made positive.
        largest = matrix[np.abs(matrix).argmax(axis=0), np.arange(matrix.shape[1])]
        return cls(matrix * np.where(largest < 0, -1.0, 1.0))

    def latents(self, inputs: Sequence[Column]) -> list[Column]:
        return [_weighted(w, inputs) for w in self.matrix.T]
