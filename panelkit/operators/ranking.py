"""Exact ranks and exact-size samples without a global sort.

Rows are ordered by a hash of their key. The leading hash digits cut that order into many even
buckets, whatever the skew of the data; counting the buckets gives each one's offset, and only
inside a bucket are rows sorted. Nothing sorts a whole class in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.hashing import digest

DIGITS = 4  # 16**4 = 65,536 buckets per stratum


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def same(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal names where null equals null; each name stays once, from the left."""
    other = right.select(*[F.col(c).alias(f"_of_{c}") if c in names else F.col(c) for c in right.columns])
    on = [left[c].eqNullSafe(other[f"_of_{c}"]) for c in names]
    return left.join(other, on, how).drop(*[f"_of_{c}" for c in names])


def hash_rank(df: DataFrame, key, salt: str, strata: Sequence[str] = (), lead: str | None = None,
              column: str = "rank") -> DataFrame:
    """Rank 1..n within each stratum, by hash order; ``lead`` sorts first, largest first.

    A null stratum, lead or key counts as a value. Rows with equal keys get ranks of their own, in any order.
    """
    keys, strata = _keys(key), list(strata)
    leads = [lead] if lead else []
    cell = strata + leads + ["_bucket"]
    marked = df.withColumn("_hash", digest(keys, salt)).withColumn(
        "_bucket", F.substring("_hash", 1, DIGITS))
    offsets = marked.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    head = Window.unboundedPreceding
    in_lead = Window.partitionBy(*strata, *leads).orderBy("_bucket").rowsBetween(head, -1)
    offsets = offsets.withColumn("_offset", F.coalesce(F.sum("_n").over(in_lead), F.lit(0)))
    if lead:
        by_lead = Window.partitionBy(*strata).orderBy(F.desc(lead)).rowsBetween(head, -1)
        totals = marked.groupBy(*strata, lead).agg(F.count(F.lit(1)).alias("_n")).select(
            *strata, lead, F.coalesce(F.sum("_n").over(by_lead), F.lit(0)).alias("_lead_offset"))
        offsets = same(offsets, totals, strata + leads).withColumn(
            "_offset", F.col("_offset") + F.col("_lead_offset"))
    inside = Window.partitionBy(*cell).orderBy("_hash", *keys)
    ranked = marked.withColumn("_row", F.row_number().over(inside))
    joined = same(ranked, offsets.select(*cell, "_offset"), cell)
    return joined.select(*df.columns, (F.col("_offset") + F.col("_row")).cast("bigint").alias(column))


def mark_exact(df: DataFrame, quota: Callable[[Column], Column], key, salt: str,
               strata: Sequence[str] = (), column: str = "taken") -> DataFrame:
    """Flag exactly ``quota(class size)`` rows of each stratum; only one bucket's rows move.

    The rows are counted per bucket. Buckets before the one that a quota ends in are taken whole, and only that
    one is ranked. A null stratum or key counts as a value, and of rows with equal keys as many are taken as the
    quota leaves room for.
    """
    keys, strata = _keys(key), list(strata)
    groups = strata or ["_all"]
    marked = df.withColumn("_hash", digest(keys, salt)).withColumn(
        "_bucket", F.substring("_hash", 1, DIGITS))
    if not strata:
        marked = marked.withColumn("_all", F.lit(0))
    counts = marked.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(
        *groups, "_bucket", "_n", F.sum("_n").over(running).alias("_upto"),
        quota(F.sum("_n").over(Window.partitionBy(*groups))).cast("bigint").alias("_quota"))
    ends = F.col("_upto").between(F.col("_quota"), F.col("_quota") + F.col("_n") - 1)
    plan = counts.groupBy(*groups).agg(
        F.max("_quota").alias("_quota"), (F.max("_quota") >= F.sum("_n")).alias("_everything"),
        F.max(F.when(ends, F.struct("_bucket", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("rest")))
              ).alias("_end")).filter("_quota > 0")
    if strata:
        flagged = same(marked, plan, groups, "left")
    else:
        only = plan.select(F.struct("_everything", "_end").alias("p")).scalar()
        flagged = marked.withColumn("_plan", only).select("*", "_plan._everything", "_plan._end")
    last = F.coalesce(~F.col("_everything") & (F.col("_bucket") == F.col("_end._bucket")), F.lit(False))
    whole = F.coalesce(F.col("_everything") | (F.col("_bucket") < F.col("_end._bucket")), F.lit(False))
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_hash", *keys)
    ranked = flagged.filter(last).withColumn("_row", F.row_number().over(inside))
    return (flagged.filter(~last).select(*df.columns, whole.alias(column)).unionByName(
        ranked.select(*df.columns, (F.col("_row") <= F.col("_end.rest")).alias(column))))


def take_exact(df: DataFrame, n: int, key, salt: str) -> DataFrame:
    """Exactly ``n`` rows without replacement, or all rows if there are fewer."""
    return mark_exact(df, lambda total: F.lit(n), key, salt).filter("taken").drop("taken")
