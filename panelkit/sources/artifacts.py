"""Fitted arrays as a small Parquet table: ``(name, shape array<int>, values array<double>)``."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import SparkSession

SCHEMA = "name string, shape array<int>, values array<double>"


def save(spark: SparkSession, path: str, arrays: Mapping[str, np.ndarray]) -> None:
    rows = [(name, list(np.shape(a)), np.asarray(a, dtype="float64").ravel().tolist())
            for name, a in arrays.items()]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["values"], dtype="float64").reshape(r["shape"])
            for r in spark.read.schema(SCHEMA).parquet(path).collect()}
