"""Class balancing to exact sizes.

Frames carry a unique key, double features and a 0/1 label. Rows made here get textual keys of
their own, so later hash draws stay well defined; the key column of a balanced frame is a string.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.hashing import pick, uniform
from panelkit.operators import neighbors, ranking
from panelkit.session import cut_lineage

MOST_CENTROIDS = 10_000


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """One row ``(n0, n1)``."""
    return df.agg(F.count(F.when(F.col(label) == 0, 1)).alias("n0"),
                  F.count(F.when(F.col(label) == 1, 1)).alias("n1"))


def targets(sizes: DataFrame, rule: str = "fold", most: tuple[int, int] | None = None) -> DataFrame:
    """Add the class targets ``t0, t1`` a protocol calls for to a row of class sizes.

    ``fold``: keep the majority, lift the minority to 78 % of it. ``holdout`` and ``final``:
    56/44 of the rows. ``hourly_small``: 80 % of the majority, 78 % of that for the minority.
    ``most`` bounds the rows of each class; by default nothing does.
    """
    n0, n1 = F.col("n0"), F.col("n1")
    full = (1 << 62, 1 << 62) if most is None else most
    def share(x, p):
        return F.floor(x * F.lit(p))
    if rule == "fold":
        t0 = F.least(F.lit(full[0]), n0)
        t1 = F.least(F.lit(full[1]), F.greatest(n1, share(t0, 0.78)))
    elif rule in ("holdout", "final"):
        t0, t1 = F.least(F.lit(full[0]), share(n0 + n1, 0.56)), F.least(F.lit(full[1]), share(n0 + n1, 0.44))
    elif rule == "hourly_small":
        t0 = F.least(F.lit(full[0]), F.greatest(F.lit(10), share(n0, 0.8)))
        t1 = F.least(F.lit(full[1]), F.greatest(F.lit(5), share(t0, 0.78)))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return sizes.select("n0", "n1", t0.cast("bigint").alias("t0"), t1.cast("bigint").alias("t1"))


def _indexed(rows: DataFrame, key: str, salt: str) -> DataFrame:
    """Rows with a dense 0-based index in hash order."""
    return ranking.hash_rank(rows, key, salt, column="_i").withColumn("_i", F.col("_i") - 1)


def _slots(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).withColumnRenamed("id", "_slot")


def _made(prefix: str):
    return F.concat(F.lit(prefix + ":"), F.col("_slot").cast("string"))


def smote(rows: DataFrame, key: str, features: Sequence[str], n: int, k: int = 5,
          seed: int = 42, size: int | None = None, **knn_options) -> DataFrame:
    """``n`` synthetic rows, each between a random row and one of its k nearest neighbours.

    ``rows`` are the minority class only, ``size`` their number if known. Neighbours are searched for the rows
    that are drawn. Returns ``(key, features)``.
    """
    features = list(features)
    size = rows.count() if size is None else size
    k = min(k, size - 1)
    if k < 1:
        raise ValueError("too few rows for neighbours")
    base = _indexed(rows, key, f"smote:{seed}")
    slots = _slots(rows, n).select(
        "_slot", pick("_slot", f"smote:{seed}:row", size).alias("_i"),
        (pick("_slot", f"smote:{seed}:neighbour", k) + 1).alias("_rank"),
        uniform("_slot", f"smote:{seed}:step").alias("_step"))
    asked = base.join(slots.select("_i").distinct(), "_i", "left_semi")
    near = neighbors.knn(asked.select(key, F.array(*features).alias("_v")),
                         rows.select(key, F.array(*features).alias("_v")),
                         k, key, "_v", exclude_self=True, **knn_options)
    a = base.select("_i", F.col(key).alias("_a"), *[F.col(f).alias(f"_a_{f}") for f in features])
    b = rows.select(F.col(key).alias("_b"), *[F.col(f).alias(f"_b_{f}") for f in features])
    pairs = (slots.join(a, "_i")
             .join(near.select(F.col("q_id").alias("_a"), F.col("rank").alias("_rank"),
                               F.col("n_id").alias("_b")), ["_a", "_rank"])
             .join(b, "_b"))
    def between(f):
        return F.col(f"_a_{f}") + F.col("_step") * (F.col(f"_b_{f}") - F.col(f"_a_{f}"))
    return pairs.select(_made("smote").alias(key), *[between(f).alias(f) for f in features])


def interpolate_pairs(rows: DataFrame, key: str, features: Sequence[str], n: int,
                      seed: int = 42, size: int | None = None) -> DataFrame:
    """``n`` synthetic rows between two random rows, 10-90 % of the way."""
    features = list(features)
    size = rows.count() if size is None else size
    base = _indexed(rows, key, f"pairs:{seed}")
    slots = _slots(rows, n).select(
        "_slot", pick("_slot", f"pairs:{seed}:a", size).alias("_ia"),
        pick("_slot", f"pairs:{seed}:b", size).alias("_ib"),
        (F.lit(0.1) + F.lit(0.8) * uniform("_slot", f"pairs:{seed}:mix")).alias("_mix"))
    a = base.select(F.col("_i").alias("_ia"), *[F.col(f).alias(f"_a_{f}") for f in features])
    b = base.select(F.col("_i").alias("_ib"), *[F.col(f).alias(f"_b_{f}") for f in features])
    def between(f):
        return F.col(f"_a_{f}") * F.col("_mix") + F.col(f"_b_{f}") * (F.lit(1.0) - F.col("_mix"))
    return slots.join(a, "_ia").join(b, "_ib").select(
        _made("pair").alias(key), *[between(f).alias(f) for f in features])


def downsample_exact(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return ranking.take_exact(rows, n, key, f"down:{seed}")


def replicate_up(rows: DataFrame, key: str, features: Sequence[str], n: int,
                 seed: int = 42, size: int | None = None) -> DataFrame:
    """``n`` copies of rows drawn with replacement."""
    size = rows.count() if size is None else size
    base = _indexed(rows, key, f"copy:{seed}").select("_i", *features)
    slots = _slots(rows, n).withColumn("_i", pick("_slot", f"copy:{seed}:row", size))
    return slots.join(base, "_i").select(_made("copy").alias(key), *features)


def cluster_centroids(rows: DataFrame, key: str, features: Sequence[str], n: int,
                      seed: int = 42, max_iter: int = 20) -> DataFrame:
    """``n`` k-means centroids in place of the rows they stand for; needs ``n`` distinct rows, else raises.

    Every centroid goes through the driver at each iteration, and work grows with rows times centroids: more than
    ``MOST_CENTROIDS`` raise. The rows are read once.
    """
    if n > MOST_CENTROIDS:
        raise ValueError(f"{n} centroids asked, {MOST_CENTROIDS} at most; sample instead")
    features = list(features)
    vectors = cut_lineage(VectorAssembler(inputCols=features, outputCol="_vec").transform(rows).select("_vec"))
    model = KMeans(k=n, seed=seed, featuresCol="_vec", maxIter=max_iter).fit(vectors)
    vectors.unpersist()
    if len(model.clusterCenters()) < n:
        raise ValueError(f"{n} centroids asked of {len(model.clusterCenters())} distinct rows")
    centres = [(f"centroid:{i}", *[float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    schema = f"`{key}` string, " + ", ".join(f"`{f}` double" for f in features)
    return rows.sparkSession.createDataFrame(centres, schema)


def balance(df: DataFrame, key: str, label: str, features: Sequence[str], target_normal: int,
            target_sepsis: int, seed: int = 42, minority: str = "smote", majority: str = "sample",
            **knn_options) -> DataFrame:
    """Exactly ``target_normal`` zeros and ``target_sepsis`` ones (if both classes occur).

    Too few ones are filled up by ``minority``: ``smote`` (synthetic neighbours, at least two rows) or ``pairs``
    (between random rows). Too many zeros are reduced by ``majority``: ``sample`` or ``centroids`` (k-means on that
    many distinct rows). A method that cannot be carried out raises. Too many ones are sampled, too few zeros
    filled up with copies. A class already at its target stays as it is.
    """
    if minority not in ("smote", "pairs") or majority not in ("sample", "centroids"):
        raise ValueError(f"unknown method {minority!r} or {majority!r}")
    features = list(features)
    frame = df.select(F.col(key).cast("string").alias(key), *features, label)
    size = class_sizes(frame, label).first()
    if size["n0"] == 0 or size["n1"] == 0:
        return frame
    plain = [key, *features]
    ones = frame.filter(F.col(label) == 1).select(*plain)
    zeros = frame.filter(F.col(label) == 0).select(*plain)

    missing = target_sepsis - size["n1"]
    if missing > 0 and minority == "smote":
        pos = [ones, smote(ones, key, features, missing, seed=seed, size=size["n1"], **knn_options)]
    elif missing > 0:
        pos = [ones, interpolate_pairs(ones, key, features, missing, seed, size["n1"])]
    else:
        pos = [downsample_exact(ones, key, target_sepsis, seed) if missing else ones]

    extra = size["n0"] - target_normal
    if extra > 0 and majority == "centroids":
        neg = [cluster_centroids(zeros, key, features, target_normal, seed)]
    elif extra > 0:
        neg = [downsample_exact(zeros, key, target_normal, seed)]
    else:
        neg = [zeros, replicate_up(zeros, key, features, -extra, seed, size["n0"])] if extra else [zeros]

    parts = ([p.withColumn(label, F.lit(1)) for p in pos] + [p.withColumn(label, F.lit(0)) for p in neg])
    return reduce(DataFrame.unionByName, parts)
