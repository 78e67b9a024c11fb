"""Classification metrics and the tables that report them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.clinical import number_text

NAMES = ("Accuracy", "Precision", "Recall", "F1 Score")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = (),
                   digits: int = 4) -> DataFrame:
    """Accuracy, precision, recall and F1 in one pass; a zero denominator gives 0."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    def count(cond):
        return F.count(F.when(cond, 1))
    sums = df.groupBy(*by).agg(
        count(y & p).alias("tp"), count(~y & p).alias("fp"), count(y & ~p).alias("fn"),
        count(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    values = (_ratio(tp + tn, tp + fp + fn + tn), _ratio(tp, tp + fp), _ratio(tp, tp + fn),
              _ratio(2 * tp, 2 * tp + fp + fn))
    return sums.select(*by, *[F.round(v, digits).alias(n) for n, v in zip(NAMES, values)])


def fold_summary(per_fold: DataFrame, fold: str = "Fold") -> DataFrame:
    """Per-fold metrics as text, plus a last row with mean and sample SD of the rounded values."""
    order = ("F1 Score", "Precision", "Recall", "Accuracy")
    rows = per_fold.select(F.col(fold).cast("string").alias(fold),
                           *[F.col(m).cast("string").alias(m) for m in order])
    mean = per_fold.agg(*[
        F.concat(number_text(F.avg(m), 2), F.lit(" ± "),
                 F.coalesce(number_text(F.stddev_samp(m), 3), F.lit("nan"))).alias(m) for m in order])
    return rows.unionByName(mean.select(F.lit("Mean ± SD").alias(fold), *order))


def log_loss(df: DataFrame, label: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean binary cross entropy; logarithms are held at -100, so a sure miss stays finite."""
    y, p = F.col(label).cast("double"), F.col(prob)
    def log(x):
        return F.greatest(F.when(x > 0, F.ln(x)).otherwise(-100.0), F.lit(-100.0))
    loss = -(y * log(p) + (1 - y) * log(F.lit(1.0) - p))
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def reconstruction_mse(df: DataFrame, actual: str, rebuilt: str) -> DataFrame:
    """Mean squared difference of two array columns over all rows and positions."""
    squares = F.zip_with(actual, rebuilt, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    return df.agg((F.sum(total) / F.sum(F.size(actual))).alias("mse"))
