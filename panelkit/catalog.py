"""Clinical feature catalogue: names, order, reference ranges and the rules built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- Fixed values: feature names, ranges and constants that results depend on. ---
FEATURES = (
    "BaseExcess", "Temp", "Chloride", "Hct", "Hgb", "Resp", "HCO3", "SIRS", "Potassium",
    "Creatinine", "Phosphate", "FiO2", "O2Sat", "Magnesium", "SaO2", "Lactate", "pH",
    "Calcium", "BUN",
)
BOTTLENECK = (
    "Creatinine", "Hct", "Phosphate", "HCO3", "Resp", "Temp", "Hgb", "SIRS", "Potassium",
    "BaseExcess", "Chloride",
)
TOP = ("Creatinine", "Hct", "Phosphate", "HCO3", "Resp")
NORMAL_RANGE = {
    "BaseExcess": (-2.0, 2.0), "Temp": (36.1, 37.2), "Chloride": (96.0, 106.0),
    "Hct": (36.0, 50.0), "Hgb": (12.0, 17.5), "Resp": (12.0, 20.0), "HCO3": (22.0, 28.0),
    "SIRS": (0.0, 1.0), "Potassium": (3.5, 5.0), "Creatinine": (0.6, 1.2),
    "Phosphate": (2.5, 4.5), "FiO2": (0.21, 0.50), "O2Sat": (95.0, 100.0),
    "Magnesium": (1.7, 2.2), "SaO2": (95.0, 100.0), "Lactate": (0.5, 2.0), "pH": (7.35, 7.45),
    "Calcium": (8.5, 10.5), "BUN": (7.0, 20.0),
}
LIMITS = {
    "BaseExcess": (-30.0, 30.0), "Temp": (30.0, 43.0), "Chloride": (60.0, 140.0),
    "Hct": (10.0, 65.0), "Hgb": (3.0, 25.0), "Resp": (4.0, 60.0), "HCO3": (5.0, 50.0),
    "SIRS": (0.0, 4.0), "Potassium": (1.5, 9.0), "Creatinine": (0.1, 15.0),
    "Phosphate": (0.5, 12.0), "FiO2": (0.21, 1.0), "O2Sat": (50.0, 100.0),
    "Magnesium": (0.5, 6.0), "SaO2": (50.0, 100.0), "Lactate": (0.2, 25.0), "pH": (6.8, 7.8),
    "Calcium": (4.0, 18.0), "BUN": (1.0, 180.0),
}
HEATMAP_BETA = 0.9
HEATMAP_LAYERS = ("E1", "E2", "E3", "E4")
DECISION_THRESHOLD = 0.30
EVALUATION_THRESHOLD = 0.50
HIGH_RISK = 0.60
COHORT_TARGETS = (32000, 25000)
# --- end of fixed values ---

AUXILIARY = ("HR", "WBC")
RAW = tuple(f for f in FEATURES if f != "SIRS")
MEASURED = RAW + AUXILIARY
LABEL = "SepsisLabel"


def midpoint(feature: str) -> float:
    lo, hi = NORMAL_RANGE[feature]
    return (lo + hi) / 2.0


@dataclass(frozen=True)
class PanelSpec:
    """How a panel is keyed: entity, order within the entity, label and measured channels.

    ``order`` names a column whose values are comparable (a number, or a struct with
    tie-breakers). ``block`` optionally names a column that cuts one entity's history into
    consecutive pieces, so that no task has to hold a whole long history; leave it out where
    an entity's rows are bounded anyway, as in an hourly panel with one row per hour.
    """

    entity: str
    order: str
    label: str
    channels: tuple
    block: str | None = None


def catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue as a small table, one row per feature."""
    rows = [
        (f, i, f in BOTTLENECK, f in TOP, *NORMAL_RANGE[f], *LIMITS[f], round(midpoint(f), 2))
        for i, f in enumerate(FEATURES)
    ]
    schema = T.StructType(
        [T.StructField("feature", T.StringType()), T.StructField("ord", T.IntegerType()),
         T.StructField("is_bottleneck", T.BooleanType()), T.StructField("is_top", T.BooleanType())]
        + [T.StructField(c, T.DoubleType())
           for c in ("normal_lo", "normal_hi", "lim_lo", "lim_hi", "midpoint")])
    return spark.createDataFrame(rows, schema)
