"""Missing cells for tests of imputation on data that has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions import hashing


def inject_missing(df: DataFrame, key, columns, rate: float, seed: int = 42) -> DataFrame:
    """Blank each cell independently with the given probability."""
    return df.withColumns({
        c: F.when(hashing.uniform(key, f"miss:{seed}:{c}") >= rate, F.col(c)) for c in columns})
