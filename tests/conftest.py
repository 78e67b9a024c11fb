import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from panelkit import session
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("OFF")
    yield session.tune(s)
    s.stop()


def made_cohort(spark, normal, sick, missing=0.0):
    """A small labelled frame: features around their midpoints, shifted for the positive class."""
    from panelkit import catalog
    rng = np.random.default_rng(7)
    label = np.r_[np.zeros(normal), np.ones(sick)].astype(int)
    pdf = pd.DataFrame({"row_id": np.arange(len(label))})
    for f in catalog.FEATURES:
        lo, hi = catalog.NORMAL_RANGE[f]
        values = catalog.midpoint(f) + (hi - lo) * (0.2 * rng.normal(size=len(label)) + 0.8 * label)
        if f == "SIRS":
            values = np.floor(np.clip(1 + 1.2 * label + rng.normal(size=len(label)), 0, 4))
        pdf[f] = np.where(rng.random(len(label)) < missing, np.nan, np.clip(values, *catalog.LIMITS[f]))
    pdf[catalog.LABEL] = label
    df = spark.createDataFrame(pdf).replace(float("nan"), None).cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def cohort(spark):
    return made_cohort(spark, 220, 140, 0.05)
