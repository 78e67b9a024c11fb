"""Column statistics, exact quantiles, outlier flags, scaling and median filling."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import cut_lineage

SLICES = 256  # a bracket is cut into so many slices of equal width
ACCURACY = 10000  # rank error of the bracketing sketch: at most rows / ACCURACY


def numeric_columns(df: DataFrame, wanted: Sequence[str] | None = None) -> list[str]:
    """The wanted columns the frame has, or all its numeric ones."""
    if wanted:
        return [c for c in wanted if c in df.columns]
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [c for c, t in df.dtypes if t in numeric or t.startswith("decimal")]


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (kept columns, feature) with the value as double."""
    cast = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(list(keep), list(columns), "feature", "value")


def _bracket(c: str, probs: Sequence[float]) -> Column:
    """Values around each quantile of a column, from a sketch: a few ranks per ten thousand apart."""
    step = 3.0 / ACCURACY
    wanted = [q for p in probs for q in (max(0.0, p - step), min(1.0, p + step))]
    return F.percentile_approx(F.col(c).cast("double"), wanted, ACCURACY)


def _cells(brackets: list[list[float] | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (feature, q, value, c) of the values inside a bracket, and at the end of a task one row without value for
    each bracket: how many values there are (n) and lie below it, and its neighbours. A task holds a batch."""
    names = ["_i", "_q", "value", "_c", "n", "_below", "_under", "_over"]
    types = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            for i, bracket in enumerate(brackets):
                if bracket is None:
                    continue
                # NaN sorts last, as in Spark.
                v = np.sort(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
                for k in range(len(bracket) // 2):
                    low = int(np.searchsorted(v, bracket[2 * k], "left"))
                    high = int(np.searchsorted(v, bracket[2 * k + 1], "right"))
                    n, below, under, over = held.get((i, k), (0, 0, -np.inf, np.nan))
                    held[i, k] = (n + len(v), below + low, max(under, v[low - 1]) if low else under,
                                  np.fmin(over, v[high]) if high < len(v) else over)
                    if high > low:
                        values, counts = np.unique(v[low:high], return_counts=True)
                        none = [None] * len(values)
                        yield rows(np.full(len(values), i), np.full(len(values), k), values, counts, none, none, none, none)
        if held:
            n, below, under, over = zip(*held.values())
            none = [None] * len(held)
            yield rows(*zip(*held), none, none, n, below, under, over)
    return read


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles (linear interpolation) per column: ``(feature, n, q)`` with q an array.

    Two evaluations of the input, both when this is called. A sketch brackets each quantile; then one pass counts what lies below the
    bracket and keeps only the values inside it, a few per ten thousand, which are ranked after equal values are
    counted together. ``percentile`` would hold every distinct value of a column in one task. A column without
    values has no row.
    """
    probs = [float(p) for p in probs]
    return _ranked(df, columns, probs, list(df.agg(*[_bracket(c, probs) for c in columns]).first()))


def _ranked(df: DataFrame, columns: Sequence[str], probs: list[float], brackets: list[list[float] | None]) -> DataFrame:
    """The second pass, and the ranks from what it keeps."""
    cells = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(
        _cells(brackets), "_i int, _q int, value double, _c long, n long, _below long, _under double, _over double")
    # Whole brackets would be few keys; with the value among them equal values meet, and nothing else does.
    kept = cut_lineage(cells.groupBy("_i", "_q", "value").agg(
        *[F.sum(c).alias(c) for c in ("_c", "n", "_below")], F.max("_under").alias("_under"), F.min("_over").alias("_over")))
    # One row for each column and quantile.
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("_i") + 1).alias("feature")
    bound = [F.element_at(F.array(*[F.lit(b[2 * k + end] if b else None).cast("double")
                                    for b in brackets for k in range(len(probs))]),
                          F.col("_i") * len(probs) + F.col("_q") + 1) for end in (0, 1)]
    sizes = kept.where("value IS NULL").select(
        name, "_q", "n", "_below", F.nullif("_under", F.lit(float("-inf"))).alias("_under"),
        F.nanvl("_over", F.lit(None)).alias("_over"))
    inside = kept.where("value IS NOT NULL").select(
        name, "_q", "value", "_c", bound[0].alias("_lo"), bound[1].alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    # A bracket is ranked in slices, so none of it has to be sorted in one task.
    place = F.coalesce(F.try_divide(F.col("value") - lo, hi - lo), F.lit(0.0))
    slice_ = F.least(F.lit(SLICES - 1), F.floor(place * SLICES)).cast("int")
    cell = ["feature", "_q", "_slice"]
    counted = inside.withColumn("_slice", slice_)
    head = Window.unboundedPreceding
    along = Window.partitionBy("feature", "_q").orderBy("_slice").rowsBetween(head, -1)
    starts = counted.groupBy(*cell).agg(F.sum("_c").alias("_n")).select(
        *cell, F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*cell).orderBy("value").rowsBetween(head, 0)
    ranked = counted.withColumn("_in", F.sum("_c").over(within)).join(starts, cell).withColumn(
        "_upto", F.col("_start") + F.col("_in"))
    placed = ranked.join(F.broadcast(sizes), ["feature", "_q"])
    prob = F.element_at(F.array(*map(F.lit, probs)), F.col("_q") + 1)
    start = F.col("_below")
    # Positions count from 0; this value occupies [start + upto - c, start + upto - 1].
    first, last = start + F.col("_upto") - F.col("_c"), start + F.col("_upto") - 1
    at = prob * (F.col("n") - 1)
    holds = lambda position: (first <= position) & (position <= last)
    ends = placed.groupBy("feature", "_q", "n").agg(
        F.coalesce(F.max(F.when(holds(F.floor(at)), F.col("value"))),
                   F.max("_under")).alias("_lo"),
        F.coalesce(F.max(F.when(holds(F.ceil(at)), F.col("value"))),
                   F.min("_over")).alias("_hi"),
        F.max(at - F.floor(at)).alias("_f"))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")
    return ends.groupBy("feature", "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_q", value.alias("v")))),
                    lambda s: s["v"]).alias("q"))


def _moment(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.struct(F.lit(c).alias("feature"), F.count(x).alias("n"), F.avg(x).alias("mean"),
                    F.stddev_samp(x).alias("std"), F.stddev_pop(x).alias("std_pop"), F.skewness(x).alias("skew_pop"))


def _corrected(stats: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    corrected = F.when(n > 2, F.col("skew_pop") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    return stats.select("feature", "n", "mean", "std", "std_pop", corrected.alias("skew"))


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: n, mean, sample and population sd, and bias-corrected skewness, in one pass."""
    return _corrected(df.agg(*[_moment(c).alias(f"_{i}") for i, c in enumerate(columns)]).select(
        F.inline(F.array(*[f"_{i}" for i in range(len(columns))]))))


def column_profile(df: DataFrame, columns: Sequence[str], skew_limit: float = 0.75,
                   iqr_multiplier: float = 1.5) -> DataFrame:
    """Moments, quartiles, fences and the outlier rule that applies to each column.

    Two evaluations of the input, when called: moments and sketches in one aggregate, then the exact ranks. One row per column. Fewer than 5 values: no rule. Mild skew: z-score, if the column varies.
    Else: interquartile fences.
    """
    probs = [0.25, 0.5, 0.75]
    first = df.agg(*[_moment(c).alias(f"m{i}") for i, c in enumerate(columns)],
                   *[_bracket(c, probs).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    stats = df.sparkSession.createDataFrame(
        list(first[:len(columns)]),
        "feature string, n long, mean double, std double, std_pop double, skew_pop double")
    q = _ranked(df, columns, probs, list(first[len(columns):])).select(
        "feature", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))
    iqr = F.col("q75") - F.col("q25")
    rule = (F.when(F.col("n") < 5, "none")
            .when(F.abs("skew") > skew_limit, "iqr")
            .when(F.col("std") > 1e-6, "zscore").otherwise("none"))
    return _corrected(stats).join(F.broadcast(q), "feature", "left").select(
        "feature", "n", "mean", "std", "std_pop", "skew", "q25", "median", "q75",
        (F.col("q25") - F.lit(iqr_multiplier) * iqr).alias("fence_lo"),
        (F.col("q75") + F.lit(iqr_multiplier) * iqr).alias("fence_hi"),
        F.coalesce(rule, F.lit("none")).alias("rule"))


def with_statistics(df: DataFrame, stats: DataFrame, value, expressions) -> DataFrame:
    """Use a per-feature table inside row expressions, without a join.

    The table (one row per column) becomes one scalar map, looked up by
    ``expressions(lookup) -> {name: Column}``.
    """
    value = F.col(value) if isinstance(value, str) else value
    table = stats.agg(F.map_from_entries(F.collect_list(F.struct("feature", value))).alias("m"))
    marked = df.withColumn("_statistics", table.scalar())
    return marked.withColumns(expressions(lambda f: F.col("_statistics")[f])).drop("_statistics")


def flag_outliers(df: DataFrame, columns: Sequence[str], z_limit: float = 3.5,
                  profile: DataFrame | None = None, suffix: str = "_outlier") -> DataFrame:
    """Add a boolean per column: false where missing, else whether the column's rule rejects it."""
    profile = column_profile(df, columns) if profile is None else profile

    def flag(c, r):
        x = F.col(c)
        z = F.abs((x - r["mean"]) / F.nullif(r["std"], F.lit(0.0))) > z_limit
        fence = (x < r["fence_lo"]) | (x > r["fence_hi"])
        return F.coalesce(F.when(r["rule"] == "zscore", z).when(r["rule"] == "iqr", fence), F.lit(False))

    return with_statistics(df, profile, F.struct("rule", "mean", "std", "fence_lo", "fence_hi"),
                           lambda rules: {c + suffix: flag(c, rules(c)) for c in columns})


def scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fit: mean and population sd per column; a constant column scales by 1."""
    return moments(df, columns).select(
        "feature", "mean", F.when(F.col("std_pop") > 0, F.col("std_pop")).otherwise(1.0).alias("scale"))


def standardize(df: DataFrame, columns: Sequence[str], fitted: DataFrame) -> DataFrame:
    """Apply a fitted scaler: (x - mean) / scale."""
    return with_statistics(
        df, fitted, F.struct("mean", "scale"),
        lambda by: {c: (F.col(c) - by(c)["mean"]) / by(c)["scale"] for c in columns})


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return quantiles(df, columns, [0.5]).select("feature", F.col("q")[0].alias("median"))


def fill_median(df: DataFrame, columns: Sequence[str], fitted: DataFrame | None = None) -> DataFrame:
    """Missing cells get the column's median; a column without any value gets 0."""
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    fitted = medians(df, columns) if fitted is None else fitted
    return with_statistics(
        df, fitted, "median",
        lambda by: {c: F.coalesce(F.col(c).cast("double"), by(c), F.lit(0.0)) for c in columns})


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class."""
    n = F.count(F.lit(1))
    counts = df.groupBy(label).agg(n.alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", F.col("n") / total)
