"""Aggregates of scored rows, all of one run in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazmeter.functions import score
from hazmeter.functions.paths import sort_key
from hazmeter.model import Risk


def summarise(scored: DataFrame, threshold: float, fail_above: bool = False) -> DataFrame:
    """One row: counts, mean and exact median, the four bands, gate, action flags and the worst row.

    Of equal scores the worst is the one that comes last in the output's order.
    """
    over = score.exceeds(F.col("crap"), threshold)
    band = score.risk(F.col("crap"))
    # the last of the output's order among the highest scores
    worst = F.max_by(F.struct("function", "crap", "file", "start_line"), F.struct("crap", sort_key(F.col("file")), "start_line", "seq"))
    return scored.agg(
        F.count(F.lit(1)).alias("functions"), F.count_if(over).alias("exceeding"), F.count_if(F.col("coverage_join") == "ambiguous").alias("ambiguous"),
        F.coalesce(F.avg("crap"), F.lit(0.0)).alias("average_crap"), F.coalesce(F.median("crap"), F.lit(0.0)).alias("median_crap"),
        *[F.count_if(band == r.value).alias(r.value) for r in Risk],
        (F.lit(fail_above) & F.coalesce(F.bool_or(over), F.lit(False))).alias("gate_failed"),
        (F.count_if(over) == 0).alias("threshold_cleared"),
        (F.count_if(over & (F.col("coverage") < 90.0)) > 0).alias("needs_tests"), (F.count_if(over & (F.col("coverage") >= 90.0)) > 0).alias("needs_refactor"),
        (F.count("crate_name") > 0).alias("uses_packages"), worst.alias("worst"),
    )


def by_package(scored: DataFrame, threshold: float) -> DataFrame:
    """(crate_name, functions, over) of each named package, by name."""
    named = scored.where(F.col("crate_name").isNotNull())
    return named.groupBy("crate_name").agg(F.count(F.lit(1)).alias("functions"), F.count_if(score.exceeds(F.col("crap"), threshold)).alias("over")).orderBy("crate_name")


def duplicate_names(packages: DataFrame) -> DataFrame:
    """Package names that occur more than once."""
    return packages.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
