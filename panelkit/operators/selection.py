"""Filter-method feature selection: mutual information and chi-square scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit import catalog
from panelkit.functions.special import chi2_tail, digamma
from panelkit.operators import profile
from panelkit.session import cut_lineage

TIE = 1e-12  # relative gap below which two distances count as equal
BLOCK_ROWS = 1_000_000
MAX_BLOCKS = 1000


def chi2_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Chi-square of class-wise sums against sums shared out by class size.

    Values are shifted to start at 0, missing counts as 0 before the shift. Two small aggregates.
    """
    filled = df.select(label, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    per_class = profile.melt(filled, features, [label]).groupBy("feature", label).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.min("value").alias("lo"))
    everywhere = Window.partitionBy("feature")
    shifted = per_class.select(
        "feature", label, "n", (F.col("s") - F.col("n") * F.min("lo").over(everywhere)).alias("observed"))
    expected = F.col("n") / F.sum("n").over(everywhere) * F.sum("observed").over(everywhere)
    gap = F.col("observed") - F.col("expected")
    scores = shifted.withColumn("expected", expected).groupBy("feature").agg(
        F.sum(F.coalesce(F.try_divide(gap * gap, F.col("expected")), F.lit(0.0))).alias("statistic"),
        (F.count(F.lit(1)) - 1).alias("df"))

    def tail(batches):
        for pdf in batches:
            yield pdf.assign(p_value=[chi2_tail(s, d) for s, d in zip(pdf["statistic"], pdf["df"])])

    return scores.mapInPandas(tail, "feature string, statistic double, df bigint, p_value double")


def mi_binned(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) between quantile bins of each feature and the class.

    Missing values take the median. One aggregate after the exact bin edges are known.
    """
    filled = _filled(df, features, label)
    def bin_of(cuts, c):
        return F.size(F.filter(cuts, lambda e: e < F.col(c))).cast("double")
    edges = profile.quantiles(filled, features, [i / bins for i in range(1, bins)]).select("feature", "q")
    binned = profile.with_statistics(
        filled, edges, "q",
        lambda of: {c: bin_of(of(c), c) for c in features})
    cells = profile.melt(binned, features, [label]).groupBy("feature", label, "value").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    def total(*keys):
        return F.sum("n").over(Window.partitionBy("feature", *keys))
    n = total()
    term = F.col("n") / n * F.ln(F.col("n") * n / (total("value") * total(label)))
    return cells.withColumn("term", term).groupBy("feature").agg(
        F.greatest(F.sum("term"), F.lit(0.0)).alias("mi"))


def _filled(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Missing values take the column's median: one number per column, put in as a constant."""
    known = {r["feature"]: r["median"] for r in profile.medians(df, features).collect()}
    def fill(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(known.get(c)).cast("double"), F.lit(0.0))
    return df.select(label, *[fill(c).alias(c) for c in features])


def _block_count(rows: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-rows // BLOCK_ROWS)))


def _in_blocks(values: DataFrame, blocks: int):
    """A function that adds ``block`` to rows of (feature, value): value ranges of similar size."""
    if blocks == 1:
        return lambda df: df.withColumn("block", F.lit(0))
    cuts = values.groupBy("feature").agg(
        F.percentile_approx("value", [i / blocks for i in range(1, blocks)], 10 * blocks).alias("_cuts"))
    return lambda df: df.join(F.broadcast(cuts), "feature").withColumn(
        "block", F.size(F.filter("_cuts", lambda c: c < F.col("value")))).drop("_cuts")


def _halo(blocked: DataFrame, cell: Sequence[str], label: str, k: int) -> DataFrame:
    """The k outermost values of each range, handed to the ranges before and after it."""
    def outermost(order, name):
        near = Window.partitionBy(*cell).orderBy(order)
        picked = blocked.withColumn("_i", F.row_number().over(near)).filter(F.col("_i") <= k)
        return picked.groupBy(*cell).agg(F.collect_list(F.struct("value", "c", "n_class")).alias(name))
    edges = outermost(F.asc("value"), "low").join(outermost(F.desc("value"), "high"), cell)
    along = Window.partitionBy("feature", label).orderBy("block")
    before = F.flatten(F.collect_list("high").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    after = F.flatten(F.collect_list("low").over(along.rowsBetween(1, Window.unboundedFollowing)))
    halo = edges.select(*cell, F.concat(
        F.slice(F.sort_array(before, asc=False), 1, k), F.slice(F.sort_array(after), 1, k)).alias("_next"))
    halo = halo.select(*cell, F.explode("_next").alias("e"))
    return halo.select(*cell, "e.*", F.lit(True).alias("_halo"))


def mi_knn(df: DataFrame, features: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """Mutual information (nats) of a continuous feature and a class (Ross 2014, k neighbours).

    In one dimension neighbours are adjacent in sorted order. Equal values are counted together
    first; sorting happens inside value ranges, whose edges borrow the k next values from the
    ranges around them; points within a radius are counted with running sums. All of it is
    linear in the distinct values, and no class or value is sorted in one task.
    """
    filled = _filled(df, features, label)
    long = profile.melt(filled, features, [label])
    counts = long.groupBy("feature", label).agg(F.count(F.lit(1)).alias("n_class"))
    counts = counts.filter("n_class > 1")  # a class of one has no neighbour and is left out
    # Used several times below, and much smaller than the rows: written out once.
    points = cut_lineage(
        long.groupBy("feature", label, "value").agg(F.count(F.lit(1)).alias("c"))
        .join(F.broadcast(counts), ["feature", label]))
    blocks = _block_count(df.count())
    add_block = _in_blocks(long, blocks)
    cell = ["feature", label, "block"]
    around = add_block(points).select(*cell, "value", "c", "n_class", F.lit(False).alias("_halo"))
    if blocks > 1:
        around = around.unionByName(_halo(around, cell, label, k))

    w = Window.partitionBy(*cell).orderBy("value")
    here = F.struct("value", "c")
    near = [f(here, i).over(w) for i in range(1, k + 1) for f in (F.lag, F.lead)]
    ring = around.withColumn("_near", F.array_compact(F.array(*near))).filter("not _halo")
    steps = F.array_sort(F.concat(
        F.array(F.struct(F.lit(0.0).alias("d"), (F.col("c") - 1).alias("c"))),
        F.transform("_near", lambda s: F.struct(F.abs(s["value"] - F.col("value")).alias("d"), s["c"].alias("c")))))
    kk = F.least(F.lit(k), F.col("n_class") - 1)
    reached = F.aggregate(
        steps, F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("r")),
        lambda a, s: F.struct(
            (a["seen"] + s["c"]).alias("seen"),
            F.coalesce(a["r"], F.when(a["seen"] + s["c"] >= kk, s["d"])).alias("r")))["r"]
    radius = ring.withColumn("_r", reached).withColumn(
        "_slack", F.lit(TIE) * F.greatest(F.abs("value"), F.col("_r")))

    # m: points strictly inside the radius (itself included), by two positions in sorted order.
    v, r = F.col("value"), F.col("_r")
    ask = radius.select("feature", label, v.alias("at"), F.explode(F.array(
        F.struct(F.when(r > 0, v - r + F.col("_slack")).otherwise(v).alias("value"), F.lit(0).alias("kind")),
        F.struct(F.when(r > 0, v + r - F.col("_slack")).otherwise(v).alias("value"), F.lit(2).alias("kind")))
    ).alias("q")).select("feature", label, "at", "q.*", F.lit(0).cast("bigint").alias("c"))
    have = points.groupBy("feature", "value").agg(F.sum("c").alias("c")).select(
        "feature", F.lit(None).cast(dict(df.dtypes)[label]).alias(label), F.lit(None).cast("double").alias("at"),
        "value", F.lit(1).alias("kind"), "c")
    line = add_block(have.unionByName(ask))
    sizes = line.groupBy("feature", "block").agg(F.sum("c").alias("c"))
    ahead = Window.partitionBy("feature").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("feature", "block", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("start"))
    upto = Window.partitionBy("feature", "block").orderBy("value", "kind").rowsBetween(
        Window.unboundedPreceding, 0)
    counted = (line.withColumn("_upto", F.sum("c").over(upto)).filter("kind <> 1")
               .join(F.broadcast(starts), ["feature", "block"]))
    position = F.col("start") + F.col("_upto")
    within = counted.groupBy("feature", label, F.col("at").alias("value")).agg(
        F.sum(F.when(F.col("kind") == 2, position).otherwise(-position)).alias("m"))
    scored = points.join(within, ["feature", label, "value"])
    c = F.col("c")
    n = F.sum(c)
    parts = scored.groupBy("feature").agg(
        n.alias("n"), (F.sum(c * digamma(kk)) / n).alias("k_term"),
        (F.sum(c * digamma(F.col("n_class"))) / n).alias("class_term"),
        (F.sum(c * digamma(F.col("m"))) / n).alias("m_term"))
    mi = digamma(F.col("n")) + F.col("k_term") - F.col("class_term") - F.col("m_term")
    return parts.select("feature", F.greatest(mi, F.lit(0.0)).alias("mi"))


@dataclass
class TwoTierSelector:
    """Top continuous features by mutual information, plus the best significant categorical one.

    ``method="binned"`` swaps the neighbour estimate for quantile bins.
    """

    n_continuous: int = 18
    categorical: Sequence[str] = ("SIRS", "Gender")
    alpha: float = 0.05
    method: str = "knn"
    mi_scores: dict = field(default_factory=dict)
    chi2: dict = field(default_factory=dict)
    selected: list = field(default_factory=list)
    fitted: bool = False

    def scores(self, df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
        """``(feature, kind, score, significant, p_value, rank)`` for every candidate, as one DataFrame."""
        cat = [c for c in self.categorical if c in features]
        cont = [c for c in features if c not in cat]
        tables = []
        if cont:
            estimate = mi_knn if self.method == "knn" else mi_binned
            tables.append(estimate(df, cont, label).select(
                "feature", F.lit("continuous").alias("kind"), F.col("mi").alias("score"),
                F.lit(True).alias("significant"), F.lit(None).cast("double").alias("p_value")))
        if cat:
            tables.append(chi2_scores(df, cat, label).select(
                "feature", F.lit("categorical").alias("kind"), F.col("statistic").alias("score"),
                (F.col("p_value") < self.alpha).alias("significant"), "p_value"))
        both = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
        best = Window.partitionBy("kind").orderBy(F.desc("significant"), F.desc("score"), "feature")
        return both.withColumn("rank", F.row_number().over(best))

    def kept(self, scores: DataFrame) -> DataFrame:
        limit = F.when(F.col("kind") == "continuous", F.lit(self.n_continuous)).otherwise(F.lit(1))
        return scores.filter(F.col("significant") & (F.col("rank") <= limit))

    def fit(self, df: DataFrame, label: str, features: Sequence[str] | None = None) -> "TwoTierSelector":
        """Keep scores, p-values and the selection: features in catalogue order, then others by kind and rank."""
        table = self.scores(df, label, list(features or [c for c in profile.numeric_columns(df) if c != label]))
        place = F.array_position(F.array(*[F.lit(f) for f in catalog.FEATURES]), F.col("feature"))
        limit = F.when(F.col("kind") == "continuous", F.lit(self.n_continuous)).otherwise(F.lit(1))
        rows = table.select("*", (F.col("significant") & (F.col("rank") <= limit)).alias("kept")).orderBy(
            F.when(place > 0, place), F.desc("kind"), "rank", "feature").collect()
        # Catalogue features sort with the others after them: nulls of an ascending order come first.
        rows = [r for r in rows if r["feature"] in catalog.FEATURES] + [
            r for r in rows if r["feature"] not in catalog.FEATURES]
        self.mi_scores = {r["feature"]: r["score"] for r in rows if r["kind"] == "continuous"}
        self.chi2 = {r["feature"]: {"statistic": r["score"], "p_value": r["p_value"], "significant": r["significant"]}
                     for r in rows if r["kind"] == "categorical"}
        self.selected = [r["feature"] for r in rows if r["kept"]]
        self.fitted = True
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The selected columns; a selector that was not fitted raises, as does a missing column."""
        if not self.fitted:
            raise RuntimeError("fit the selector before transforming")
        return df.select(*keep, *self.selected)
