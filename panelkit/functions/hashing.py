"""Randomness as a function of a row's own key.

``rand(seed)`` changes with partitioning and on a retried task. Draws taken from a hash of the
row key do not: every sample, fold, noise term and shuffle here is a pure function of the data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(key, salt: str) -> Column:
    """Hex digest of one key column (or several) and a salt; a null has a mark of its own."""
    keys = key if isinstance(key, (list, tuple)) else [key]
    cols = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("\\N")) for k in keys]
    return F.md5(F.concat_ws(":", *cols, F.lit(salt)))


def _word(key, salt: str, place: int = 1) -> Column:
    """32 bits of the digest as a number, from its ``place``-th group of eight digits."""
    return F.conv(F.substring(digest(key, salt), 8 * place - 7, 8), 16, 10).cast("bigint")


def uniform(key, salt: str, place: int = 1) -> Column:
    """Uniform draw in [0, 1)."""
    return _word(key, salt, place) / F.lit(4294967296.0)


def pick(key, salt: str, n) -> Column:
    """Uniform integer in [0, n)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(uniform(key, salt) * n).cast("bigint")
