"""Session settings the operators rely on, and the shared folder for cut lineages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when an aggregation on the same key follows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings; cluster sizing is left to whoever submits the job."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared ``spark.checkpoint.dir``, so lost executors cost no recompute.

    Without that setting ``df`` is persisted instead: what an executor loses is computed again.
    """
    sc = df.sparkSession.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None and configured:
        sc.setCheckpointDir(configured)
    if sc.getCheckpointDir() is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df.checkpoint(eager=True)


def right_size(cached: DataFrame) -> DataFrame:
    """No more tasks over a cached frame than the cluster runs at once, for jobs that read it again and again."""
    at_once = cached.sparkSession.sparkContext.defaultParallelism
    return cached.coalesce(at_once) if cached.rdd.getNumPartitions() > at_once else cached


def sum_arrays(partials: DataFrame, size: int, fan: int = 16) -> np.ndarray:
    """Element-wise sum of one ``array<double>`` column ``v`` of fixed length, one array per task.

    Arrays are added in a tree of fixed order, ``fan`` neighbours at a time, so the result is the same at every
    run; what reaches the driver are ``fan`` arrays at most.
    """
    width, level = partials.rdd.getNumPartitions(), partials.withColumn("n", F.spark_partition_id().cast("long"))

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n")
        return pd.DataFrame({"v": [np.sum(np.stack(group["v"].to_list()), axis=0)], "n": [group["n"].iloc[0] // fan]})

    while width > fan:
        level = level.groupBy(F.floor(F.col("n") / fan).alias("g")).applyInPandas(
            lambda key, group: add(group), "v array<double>, n long")
        width = -(-width // fan)
    rows = sorted(level.collect(), key=lambda r: r["n"])
    return np.sum([np.asarray(r["v"]) for r in rows] or [np.zeros(size)], axis=0)


def sum_blocks(parts: RDD, size: int, fan: int = 16) -> np.ndarray:
    """``sum_arrays`` for an RDD of (partition, doubles as bytes), one array for each of its partitions.

    Jobs of an RDD are not planned anew, which tells where a fit is hundreds of short ones.
    """
    def total(group) -> np.ndarray:
        out = np.zeros(size)
        for _, buffer in sorted(group, key=lambda p: p[0]):
            out += np.frombuffer(buffer)
        return out

    width = parts.getNumPartitions()
    while width > fan:
        width = -(-width // fan)
        parts = parts.map(lambda p: (p[0] // fan, p)).groupByKey(width).map(lambda g: (g[0], total(g[1]).tobytes()))
    return total(parts.collect())
