"""Cross-validation protocols and the comparison table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit import catalog
from panelkit.functions import clinical
from panelkit.models import classical
from panelkit.operators import balance, impute, metrics, profile, split
from panelkit.plans.model import LatentModel
from panelkit.session import cut_lineage

FEATURES = list(catalog.FEATURES)


def prepare(train: DataFrame, test: DataFrame, key: str, label: str, seed: int = 42,
            features: Sequence[str] = FEATURES, sweeps: int = 10, rule: str | None = "fold",
            targets: tuple[int, int] | None = None, schedule: str = "block",
            most: tuple[int, int] | None = None):
    """Impute (fitted on the training rows only), clip both parts, balance the training part.

    The training part goes to ``targets`` or to those of ``rule``, bounded by ``most`` rows of each class if given.
    """
    features = list(features)
    train, test = (d.withColumn(key, F.col(key).cast("string")) for d in (train, test))
    imputer = impute.ChainedImputer(features, sweeps, seed, schedule=schedule).fit(train, key)
    train = clinical.clip_limits(imputer.transform(train.select(key, *features, label), key))
    test = clinical.clip_limits(imputer.transform(test.select(key, *features, label), key))
    if rule is not None:
        # Balancing reads the imputed rows several times: written out once, in the shared folder.
        train = cut_lineage(train)
        if targets is None:
            goal = balance.targets(balance.class_sizes(train, label), rule, most).first()
            targets = (goal["t0"], goal["t1"])
        train = balance.balance(train, key, label, features, *targets, seed)
    return train, test


def _fold_metrics(train, test, key, label, features, fold, training) -> tuple:
    model = LatentModel.fit(train, key, label, features, **training)
    decided = model.probabilities(test, [key, label]).withColumn(
        "prediction", clinical.above(F.col("prob"), catalog.EVALUATION_THRESHOLD))
    scored = metrics.binary_metrics(decided, label, "prediction").first()
    return (str(fold), *[float(scored[m]) for m in metrics.NAMES])


def _table(spark, rows) -> DataFrame:
    schema = "Fold string, " + ", ".join(f"`{m}` double" for m in metrics.NAMES)
    return metrics.fold_summary(spark.createDataFrame(rows, schema))


def leakage_free_cv(df: DataFrame, key: str, label: str = catalog.LABEL, group: str | None = None,
                    k: int = 5, balance_training: bool = True, targets: tuple[int, int] | None = None,
                    most: tuple[int, int] | None = None, seed: int = 42, features: Sequence[str] = FEATURES,
                    sweeps: int = 10, schedule: str = "block", **training) -> DataFrame:
    """k-fold evaluation in which a validation fold touches nothing that is fitted.

    Folds come first, by group when there is one; imputation, balancing and scaling see training
    rows only. ``targets`` are the class sizes to balance to, else the fold rule's, of at most ``most`` rows of
    each class (no bound by default). ``training`` goes to ``LatentModel.fit``. Returns a row per fold and the
    mean and SD.
    """
    if group is not None:
        folds = split.group_kfold(df, group, label, k, seed)
        if not split.leaking_groups(folds, group).isEmpty():
            raise RuntimeError("a group was split over folds")
    else:
        folds = split.stratified_kfold(df, key, label, k, seed)
    folds = folds.select(key, *features, label, "fold").persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        for f in range(k):
            train, test = prepare(
                folds.filter(F.col("fold") != f), folds.filter(F.col("fold") == f), key, label,
                seed + f + 1, features, sweeps, "fold" if balance_training else None, targets, schedule, most)
            # The trainer and the scaler both read it; synthetic rows are costly to make twice.
            train = train.persist(StorageLevel.MEMORY_AND_DISK)
            rows.append(_fold_metrics(train, test, key, label, features, f + 1, training))
            train.unpersist()
    finally:
        folds.unpersist()
    return _table(df.sparkSession, rows)


def balanced_cv(df: DataFrame, key: str, label: str = catalog.LABEL, k: int = 5, seed: int = 42,
                features: Sequence[str] = FEATURES, **training) -> DataFrame:
    """k-fold evaluation of a cohort that is already imputed and balanced, without groups."""
    folds = split.stratified_kfold(df, key, label, k, seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = [_fold_metrics(folds.filter(F.col("fold") != f), folds.filter(F.col("fold") == f), key,
                              label, features, f + 1, training) for f in range(k)]
    finally:
        folds.unpersist()
    return _table(df.sparkSession, rows)


def comparison_table(df: DataFrame, key: str, label: str = catalog.LABEL, group: str | None = None,
                     seed: int = 42, features: Sequence[str] = FEATURES, sweeps: int = 10,
                     schedule: str = "block", most: tuple[int, int] | None = None, chosen=None) -> DataFrame:
    """The nine baselines on a hold-out split: prepared without leakage, scaled, scored."""
    # The split reads the rows several times; imputer, both parts and every fit read the split. Both are made once.
    df = cut_lineage(df.select(*dict.fromkeys([key, *([] if group is None else [group]), *features, label])))
    if group is not None:
        tagged = split.group_kfold(df, group, label, 5, seed).withColumn("is_test", F.col("fold") == 0)
    else:
        tagged = split.holdout(df, key, label, 0.2, seed)
    tagged = cut_lineage(tagged.select(key, *features, label, "is_test"))
    train, test = prepare(tagged.filter("not is_test"), tagged.filter("is_test"), key, label, seed,
                          features, sweeps, "holdout", schedule=schedule, most=most)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    fitted = profile.scaler(train, features)
    table = classical.benchmark(profile.standardize(train, features, fitted),
                                profile.standardize(test, features, fitted), features, label, key, chosen)
    train.unpersist()
    tagged.unpersist()
    df.unpersist()
    return table
