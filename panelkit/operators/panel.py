"""Ordered per-entity operators: boundary, truncation, carry-forward and boundary state.

Whatever can be an aggregate is one, because partial aggregation absorbs a hot entity. Where
order matters (carry-forward) a panel may name a block column; each block is filled on its own
and the values carried between blocks come from a per-block summary, so no task holds one long
history. Entity keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.catalog import PanelSpec
from panelkit.functions import clinical
from panelkit.operators import ranking


def _positive(spec: PanelSpec):
    return F.col(spec.label) == 1


def boundary(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per entity: ``is_positive`` and the order key of its first positive row."""
    return df.groupBy(spec.entity).agg(
        F.max(F.when(_positive(spec), 1).otherwise(0)).alias("is_positive"),
        F.min(F.when(_positive(spec), F.col(spec.order))).alias("boundary"))


def truncate_history(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Drop what comes after an entity's first positive row; entities without one stay whole."""
    # The boundary comes from a partial aggregation and only positive entities are joined,
    # so a hot entity's rows can be split over tasks (adaptive skew join).
    firsts = boundary(df, spec).filter("is_positive = 1").select(
        spec.entity, F.col("boundary").alias("_boundary"))
    marked = df.join(firsts, spec.entity, "left")
    return marked.filter(
        F.col("_boundary").isNull() | (F.col(spec.order) <= F.col("_boundary"))).drop("_boundary")


def locf(df: DataFrame, spec: PanelSpec, channels: Sequence[str] | None = None,
         backfill: bool = False) -> DataFrame:
    """Carry the last observation forward, and optionally the first one backward.

    Backfilling copies later values to earlier rows, past any boundary; use it only where the
    history was truncated before or where that look-ahead is meant.
    """
    channels = list(channels or spec.channels)
    within = [spec.entity] + ([spec.block] if spec.block else [])
    w = Window.partitionBy(*within).orderBy(spec.order)
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    future = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    fwd = {c: F.last(c, ignorenulls=True).over(past) for c in channels}
    bwd = {c: F.first(c, ignorenulls=True).over(future) for c in channels}
    if spec.block is None:
        return df.withColumns(
            {c: F.coalesce(fwd[c], bwd[c]) if backfill else fwd[c] for c in channels})

    order = F.col(spec.order)
    ends = df.groupBy(*within).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_last_{c}") for c in channels],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_first_{c}") for c in channels])
    wb = Window.partitionBy(spec.entity).orderBy(spec.block)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    after = wb.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(
        *within,
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_prev_{c}") for c in channels],
        *[F.first(f"_first_{c}", ignorenulls=True).over(after).alias(f"_next_{c}") for c in channels])
    local = df.withColumns({f"_fwd_{c}": fwd[c] for c in channels}
                           | ({f"_bwd_{c}": bwd[c] for c in channels} if backfill else {}))
    joined = local.join(carried, within, "left")
    filled = {}
    for c in channels:
        parts = [F.col(f"_fwd_{c}"), F.col(f"_prev_{c}")]
        if backfill:
            parts += [F.col(f"_bwd_{c}"), F.col(f"_next_{c}")]
        filled[c] = F.coalesce(*parts)
    return joined.withColumns(filled).select(*df.columns)


def patient_vector(df: DataFrame, spec: PanelSpec, sirs: bool = True) -> DataFrame:
    """State at the boundary: per entity the last known value of every channel, and its label.

    Equal to truncating, carrying forward and taking the last row, but as one aggregate.
    """
    order = F.col(spec.order)
    state = truncate_history(df, spec).groupBy(spec.entity).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in spec.channels],
        F.max(F.when(_positive(spec), 1).otherwise(0)).alias(spec.label))
    return clinical.with_sirs(state) if sirs else state


def hourly_cohort(df: DataFrame, spec: PanelSpec, backfill: bool = True) -> DataFrame:
    """Every hour as one labelled sample, filled over the whole stay, with SIRS per row.

    Rows without a label are refused, since they belong to neither class.
    """
    filled = locf(df, spec, backfill=backfill)
    label = F.when(F.col(spec.label).isNull(), F.raise_error(F.lit("row without a label"))).otherwise(
        F.col(spec.label))
    return clinical.with_sirs(filled).withColumn(spec.label, label.cast("int"))


def measured_only(df: DataFrame, channels: Sequence[str], at_least: int = 1) -> DataFrame:
    """Keep rows with at least so many measured channels."""
    known = sum((F.col(c).isNotNull().cast("int") for c in channels), F.lit(0))
    return df.filter(known >= at_least)


def sample_entities(df: DataFrame, spec: PanelSpec, n: int, seed: int = 42) -> DataFrame:
    """All rows of exactly ``n`` entities drawn without replacement (all, if there are fewer)."""
    ids = df.select(spec.entity).distinct()
    chosen = ranking.take_exact(ids, n, key=spec.entity, salt=f"entities:{seed}")
    return df.join(chosen, spec.entity, "left_semi")


def first_entities(df: DataFrame, spec: PanelSpec, n: int = 20) -> DataFrame:
    """All rows of the ``n`` entities that sort first, with the hour's ordinal per entity.

    With a block column, hours are numbered within blocks and shifted by the rows of the blocks before.
    """
    ids = df.select(spec.entity).distinct().orderBy(spec.entity).limit(n)
    rows = df.join(ids, spec.entity, "left_semi")
    if spec.block is None:
        return rows.withColumn("Hour", F.row_number().over(Window.partitionBy(spec.entity).orderBy(spec.order)))
    cell = [spec.entity, spec.block]
    before = Window.partitionBy(spec.entity).orderBy(spec.block).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).select(
        *cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(spec.order))
    return rows.withColumn("_in", inside).join(starts, cell).select(
        *df.columns, (F.col("_in") + F.col("_before")).cast("int").alias("Hour"))
