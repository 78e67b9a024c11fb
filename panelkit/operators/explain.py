"""Heatmaps, attributions and waterfalls."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit import catalog
from panelkit.functions.hashing import digest

MOST_BACKGROUND = 10_000  # rows of a background that ride along with every row
BACKGROUND_ROWS = 100  # usual size of the reference population that attributions compare with


def background(df: DataFrame, key: str, n: int = BACKGROUND_ROWS, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest key hash: a fixed sample however data is laid out."""
    return df.orderBy(digest(key, f"background:{seed}"), key).limit(n)


def heatmap_cells(df: DataFrame, keep: Sequence[str], features: Sequence[str],
                  column: str = "heatmaps") -> DataFrame:
    """One row per (row, layer, feature) with the heatmap value."""
    layers = df.select(*keep, F.explode(column).alias("layer", "_map"))
    cells = layers.select(*keep, "layer", F.posexplode("_map").alias("_at", "value"))
    names = F.array(*[F.lit(f) for f in features])
    return cells.select(*keep, "layer", F.get(names, F.col("_at")).alias("feature"), "value")


def discounted_scores(cells: DataFrame, keep: Sequence[str], beta: float = catalog.HEATMAP_BETA,
                      layers: Sequence[str] = catalog.HEATMAP_LAYERS) -> DataFrame:
    """Sum over the layers, the i-th one weighted with beta**i, per row and feature."""
    weight = F.create_map(*[x for i, n in enumerate(layers, 1) for x in (F.lit(n), F.lit(beta ** i))])
    return cells.filter(F.col("layer").isin(*layers)).groupBy(*keep, "feature").agg(
        F.sum(weight[F.col("layer")] * F.col("value")).alias("score"))


def rank_features(scores: DataFrame, keep: Sequence[str], top: int | None = None,
                  features: Sequence[str] = catalog.FEATURES) -> DataFrame:
    """Rank each row's features by score, ties in catalogue order; optionally the first ``top``."""
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    order = Window.partitionBy(*keep).orderBy(F.desc("score"), place)
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top) if top else ranked


def ranked_heatmap(column: str = "heatmaps", features: Sequence[str] = catalog.FEATURES,
                   beta: float = catalog.HEATMAP_BETA) -> Column:
    """The same ranking inside one row, as an array of (feature, score): no shuffle."""
    maps = [F.col(column)[n] for n in catalog.HEATMAP_LAYERS]
    total = F.transform(maps[0], lambda v: v * beta)
    for i, m in enumerate(maps[1:], 2):
        total = F.zip_with(total, F.transform(m, lambda v: v * (beta ** i)), lambda a, b: a + b)
    return _by_size(F.zip_with(F.array(*[F.lit(f) for f in features]), total,
                               lambda f, s: F.struct(f.alias("feature"), s.alias("score"))), "score")


def _by_size(items: Column, field: str, absolute: bool = False) -> Column:
    """Sort an array of structs by a field, largest first; equal ones keep their order."""
    def size(x):
        return F.abs(x[field]) if absolute else x[field]
    placed = F.transform(items, lambda x, i: F.struct((-size(x)).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda p: p["x"])


def attributions(df: DataFrame, features: Sequence[str], score: Callable[[Mapping[str, Column]], Column],
                 reference: DataFrame | Sequence[Sequence[float]], column: str = "attributions",
                 used: Sequence[str] | None = None) -> DataFrame:
    """Append perturbation attributions of ``score``, a function from feature columns to a column.

    A feature's drop is the mean fall of the score when the feature takes its values in the background instead.
    Drops are rescaled so that they add up to the row's score minus the mean score of the background; if they
    cancel out, that difference is shared equally. An empty background gives null.

    ``reference`` is the background as the caller chose it (see ``background``), all of it: a DataFrame, which
    becomes one array beside the rows, or rows of numbers, for streams. More than ``MOST_BACKGROUND`` rows raise. ``used`` names the features that the score
    depends on, if not all do; the others' drop is zero.
    """
    names = list(features)
    used = set(names if used is None else used)
    if isinstance(reference, DataFrame):
        one = F.struct(*[F.col(f).cast("double").alias(f) for f in names])
        if reference.limit(MOST_BACKGROUND + 1).count() > MOST_BACKGROUND:
            raise ValueError(f"a background of over {MOST_BACKGROUND} rows; take a sample (see background)")
        rows = reference.agg(F.collect_list(one)).scalar()
    else:
        rows = F.array(*[F.struct(*[F.lit(float(v)).alias(f) for f, v in zip(names, r)]) for r in reference])
    own = {f: F.col(f) for f in names}

    def mean(term: Callable[[Column], Column]) -> Column:
        total = F.aggregate("_reference", F.lit(0.0), lambda s, b: s + term(b))
        return F.try_divide(total, F.size("_reference"))

    def drops(fx: Column) -> Column:
        return F.array(*[mean(lambda b, f=f: fx - score({**own, f: b[f]})) if f in used else F.lit(0.0)
                         for f in names])

    def rescaled(gap: Column, fallen: Column, total: Column) -> Column:
        factor = gap / F.nullif(total, F.lit(0.0))
        return F.when(gap.isNotNull(), F.when(F.abs(total) > 1e-6, F.transform(fallen, lambda d: d * factor))
                      .otherwise(F.transform(fallen, lambda d: gap / len(names))))

    base = mean(lambda b: score({f: b[f] for f in names}))
    out = _let(score(own), lambda fx: _let(
        F.struct((fx - base).alias("gap"), drops(fx).alias("fallen")), lambda s: _let(
            F.aggregate(s["fallen"], F.lit(0.0), lambda t, d: t + d),
            lambda total: rescaled(s["gap"], s["fallen"], total))))
    return df.withColumn("_reference", rows).withColumn(column, out).drop("_reference")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def waterfall(features: Sequence[str], attributions: str = "attributions",
              values: Mapping[str, Column] | None = None,
              top: Sequence[str] = catalog.TOP) -> Column:
    """Array of structs, largest absolute (rounded) attribution first.

    ``values`` adds each feature's own value; without it the field is absent.
    """
    items = []
    for i, f in enumerate(features):
        v = F.get(attributions, F.lit(i))
        fields = [F.lit(f).alias("feature")]
        if values is not None:
            fields.append(F.round(values.get(f, F.lit(0.0)), 2).alias("patient_value"))
        fields += [F.round(v, 4).alias("shap_value"),
                   F.when(v > 0, "contributing").otherwise("offsetting").alias("impact"),
                   F.lit(f in top).alias("is_top_impact")]
        items.append(F.struct(*fields))
    return _by_size(F.array(*items), "shap_value", absolute=True)


def top_factors(column: str, impact: str, n: int = 3) -> Column:
    """Names of the first ``n`` contributing or offsetting features of a waterfall."""
    return F.transform(F.slice(F.filter(column, lambda w: w["impact"] == impact), 1, n),
                       lambda w: w["feature"])


def global_importance(df: DataFrame, features: Sequence[str], attributions: str = "attributions",
                      top: Sequence[str] = catalog.TOP) -> DataFrame:
    """Mean absolute attribution per feature over all rows, most important first."""
    names = F.array(*[F.lit(f) for f in features])
    # The outer form keeps the optimizer from computing attributions once more to test for empty arrays.
    cells = df.select(F.posexplode_outer(attributions).alias("_at", "v")).filter("_at is not null")
    means = cells.groupBy("_at").agg(F.round(F.avg(F.abs("v")), 4).alias("mean_shap_score"))
    return means.select(F.get(names, F.col("_at")).alias("feature"), "mean_shap_score",
                        F.get(names, F.col("_at")).isin(*top).alias("is_top_impact"), "_at").orderBy(
        F.desc("mean_shap_score"), "_at").drop("_at")
