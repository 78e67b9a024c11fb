"""Special functions Spark SQL lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digamma(x: Column, shift: int = 8) -> Column:
    """Digamma for x >= 1: recurrence up to where the asymptotic series is exact to 1e-12."""
    x = x.cast("double")
    y = x + float(shift)
    inv2 = F.lit(1.0) / (y * y)
    series = F.ln(y) - F.lit(0.5) / y - inv2 * (
        F.lit(1.0 / 12) - inv2 * (F.lit(1.0 / 120) - inv2 * (F.lit(1.0 / 252) - inv2 * F.lit(1.0 / 240))))
    steps = F.lit(0.0)
    for i in range(shift):
        steps = steps + F.lit(1.0) / (x + float(i))
    return series - steps


def chi2_tail(statistic: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom >= statistic)."""
    if statistic <= 0 or df < 1:
        return 1.0
    half = statistic / 2.0
    if df % 2:
        tail, step, term = math.erfc(math.sqrt(half)), 1, math.sqrt(half) * 2 / math.sqrt(math.pi)
    else:
        tail, step, term = math.exp(-half), 2, half
    while step < df:
        tail += term * math.exp(-half)
        step += 2
        term *= half / (step / 2.0)
    return min(1.0, tail)
