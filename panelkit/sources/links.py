"""Link listings: distinct link targets in HTML that match a pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATIENT_LINK = r'href="(p\d+\.psv)"'


def links(pages: DataFrame, html: str = "html", pattern: str = PATIENT_LINK) -> DataFrame:
    """Sorted distinct values of the pattern's first group, over all pages."""
    found = pages.select(F.explode(F.regexp_extract_all(html, F.lit(pattern), 1)).alias("link"))
    return found.distinct().orderBy("link")
