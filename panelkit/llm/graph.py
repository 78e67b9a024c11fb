"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import settle


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root): every vertex of ``edges`` (a, b) with the smallest vertex that it is connected to.

    Alternates two steps until nothing changes: larger neighbours move to a vertex's smallest neighbour,
    then the smaller ones. Each step is a grouped minimum, combined before the shuffle, and a join that
    adaptive execution can split at a hot vertex; no step holds a component or a vertex's neighbours in
    memory. Null ends and loops are ignored; an empty edge list gives no rows.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where("a <> b").distinct())
    state = lambda: now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = state()
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        # No round has more edges than the one before.
        now = settle(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .distinct(), seen[0])
        before, seen = seen, state()
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(roots)
