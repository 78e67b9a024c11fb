"""Records to score: JSON bodies or maps of feature to value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit import catalog
from panelkit.functions import clinical


def from_json(df: DataFrame, body: str = "value", field: str | None = "vitals") -> DataFrame:
    """Add ``vitals``, a map of feature to text, from a JSON body (values may be any scalar)."""
    if field:
        parsed = F.from_json(body, f"{field} map<string,string>")[field]
    else:
        parsed = F.from_json(body, "map<string,string>")
    return df.withColumn("vitals", parsed)


def from_map(df: DataFrame, vitals: str = "vitals", keep: Sequence[str] = ()) -> DataFrame:
    """One typed, defaulted, clipped row of all features per record, with its warnings."""
    values = {f: F.col(vitals)[f] for f in catalog.FEATURES}
    return clinical.accept_record(df, values, keep)
