"""Hold-out and fold assignment, and the guard against entities on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators import ranking


def holdout(df: DataFrame, key, label: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Stratified hold-out: ``is_test`` marks exactly floor(fraction * class size) rows per class."""
    return ranking.mark_exact(df, lambda total: F.floor(total * F.lit(fraction)), key,
                              f"holdout:{seed}", [label], "is_test")


def kfold(df: DataFrame, key, k: int = 5, seed: int = 42, strata: Sequence[str] = ()) -> DataFrame:
    """Add ``fold`` 0..k-1: sizes differ by at most one, per stratum when strata are given."""
    ranked = ranking.hash_rank(df, key, f"fold:{seed}", strata, column="_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def stratified_kfold(df: DataFrame, key, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    return kfold(df, key, k, seed, [label])


def _serpentine(rank: Column, k: int) -> Column:
    at = rank - 1
    place = F.pmod(at, F.lit(k))
    forward = F.pmod(F.floor(at / k), F.lit(2)) == 0
    return F.when(forward, place).otherwise(k - 1 - place).cast("int")


def group_fold_table(df: DataFrame, group: str, label: str | None = None, k: int = 5,
                     seed: int = 42) -> DataFrame:
    """Fold per group: ``(group, stratum, n, fold)``.

    Groups are dealt out in snake order from the largest down, within strata of groups with and
    without positives when a label is given, which keeps fold sizes and class shares close.
    """
    positive = F.max(F.when(F.col(label) == 1, 1).otherwise(0)) if label else F.max(F.lit(0))
    groups = df.groupBy(group).agg(positive.alias("stratum"), F.count(F.lit(1)).alias("n"))
    ranked = ranking.hash_rank(groups, group, f"groups:{seed}", ["stratum"], lead="n", column="_rank")
    return ranked.select(group, "stratum", "n", _serpentine(F.col("_rank"), k).alias("fold"))


def group_kfold(df: DataFrame, group: str, label: str | None = None, k: int = 5,
                seed: int = 42) -> DataFrame:
    """Add ``fold`` such that all rows of a group share it; rows without a group are one group."""
    table = group_fold_table(df, group, label, k, seed).select(group, "fold")
    return ranking.same(df, table, [group])


def leaking_groups(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups that occur in more than one fold; empty when the split is sound."""
    per = df.groupBy(group).agg(F.min(fold).alias("_lo"), F.max(fold).alias("_hi"))
    return per.filter("_lo <> _hi").select(group)
