"""From patient files to cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit import catalog
from panelkit.functions import clinical
from panelkit.operators import balance, impute, panel
from panelkit.session import cut_lineage
from panelkit.sources import patient_files


def _stem(path: str = "file_path"):
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def patient_cohort(spark: SparkSession, paths, max_patients: int | None = None, seed: int = 42,
                   **scan_options) -> DataFrame:
    """One labelled vector per stay, as known at its boundary; missing values stay null."""
    rows = patient_files.scan_panel(spark, paths, max_files=max_patients, seed=seed, **scan_options)
    vectors = panel.patient_vector(rows, patient_files.panel_spec())
    return vectors.select("file_path", _stem().alias("patient_id"), *catalog.FEATURES, catalog.LABEL)


def hourly_rows(spark: SparkSession, paths, max_patients: int | None = None, seed: int = 42) -> DataFrame:
    """Every hour of every stay as a sample, before imputation, with a unique ``row_id``."""
    rows = patient_files.scan_panel(spark, paths, max_files=max_patients, seed=seed)
    filled = panel.hourly_cohort(rows, patient_files.panel_spec())
    key = F.md5(F.concat_ws(":", "file_path", F.to_json("ord")))
    return filled.select(key.alias("row_id"), "file_path", *catalog.FEATURES, catalog.LABEL)


def paper_cohort(rows: DataFrame, target_normal: int = catalog.COHORT_TARGETS[0],
                 target_sepsis: int = catalog.COHORT_TARGETS[1], rule: str | None = None, seed: int = 42,
                 imputer: impute.ChainedImputer | None = None, **methods) -> DataFrame:
    """Sample the majority, impute, clip and balance hourly samples into one training cohort.

    The targets are exact sizes; with a ``rule`` of ``balance.targets`` they are what it gives, bounded by them.
    ``methods`` (``minority``, ``majority``) go to ``balance.balance``.
    """
    label, key, features = catalog.LABEL, "row_id", list(catalog.FEATURES)
    if rule is not None:
        goal = balance.targets(balance.class_sizes(rows, label), rule, (target_normal, target_sepsis)).first()
        target_normal, target_sepsis = goal["t0"], goal["t1"]
    normal = balance.downsample_exact(rows.filter(F.col(label) == 0), key, target_normal, seed)
    both = normal.unionByName(rows.filter(F.col(label) == 1)).select(key, *features, label)
    imputer = imputer or impute.ChainedImputer(features, seed=seed)
    clean = cut_lineage(clinical.clip_limits(imputer.fit_transform(both, key)))
    return balance.balance(clean, key, label, features, target_normal, target_sepsis, seed, **methods)


def load_paper_cohort(spark: SparkSession, paths, target_normal: int = catalog.COHORT_TARGETS[0],
                      target_sepsis: int = catalog.COHORT_TARGETS[1],
                      max_patients: int | None = None, seed: int = 42, rule: str | None = None,
                      sweeps: int = 10, **methods) -> DataFrame:
    """``paper_cohort`` from files; ``max_patients`` draws a sample of them, and changes nothing else."""
    rows = hourly_rows(spark, paths, max_patients, seed)
    imputer = impute.ChainedImputer(list(catalog.FEATURES), sweeps, seed)
    return paper_cohort(rows, target_normal, target_sepsis, rule, seed, imputer, **methods)


def hour_extract(spark: SparkSession, paths, n: int = 20,
                 features: Sequence[str] = catalog.FEATURES) -> DataFrame:
    """Patient-hour rows of the first ``n`` files: hour ordinal, features (absent ones null), label."""
    columns = [*features, catalog.LABEL]
    rows = patient_files.scan_panel(spark, paths, channels=columns, label=None)
    return panel.first_entities(rows, patient_files.panel_spec(columns), n).select(
        "patient_id", "Hour", *features, F.col(catalog.LABEL).cast("int").alias(catalog.LABEL))
