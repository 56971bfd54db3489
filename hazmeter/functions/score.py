"""Score, bands and gate as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of the bands; above the last is high.
BANDS = ((8.0, "low"), (15.0, "acceptable"), (25.0, "moderate"))


def crap(complexity: Column, coverage: Column) -> Column:
    """``cc^2 (1 - cov)^3 + cc``, coverage in per cent and held between 0 and 100."""
    c = complexity.cast("double")
    u = 1.0 - F.greatest(F.lit(0.0), F.least(F.lit(100.0), coverage)) / 100.0
    return c * c * (u * (u * u)) + c


def risk(score: Column) -> Column:
    """Band of a score; what is not finite is high."""
    out = F.when(F.isnan(score) | (F.abs(score) == float("inf")), "high")
    for top, name in BANDS:
        out = out.when(score <= top, name)
    return out.otherwise("high")


def exceeds(score: Column, threshold: float) -> Column:
    return score > F.lit(float(threshold))
