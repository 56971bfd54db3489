"""Which coverage file belongs to a source file: a ranked join on path suffixes.

Catalyst joins on the last component; the rest is a residual predicate. A candidate path that ends with the whole
key beats one that the key ends with, then the longer match, then the exact one. Ties go to the only key that
carries the package's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazmeter.functions.paths import components, is_suffix_pair
from hazmeter.sources.lcov import saturated

ROOTS = ("src", "lib", "tests", "benches", "examples")


def coverage_keys(lines: DataFrame) -> DataFrame:
    """(path, cov_key, cov_parts): the normalised key of each distinct path of a coverage table; empty ones go."""
    keys = lines.select("path").distinct().select("path", components(F.col("path")).alias("cov_parts")).where(F.size("cov_parts") > 0)
    return keys.select("path", F.array_join("cov_parts", "/").alias("cov_key"), "cov_parts")


def normalised(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(cov_key, line, hits) of lines that are distinct by path and line; files whose keys collide are merged."""
    rows = lines.join(keys.select(F.col("path").alias("p"), "cov_key"), F.col("path") == F.col("p")).select("cov_key", "line", "hits")
    if keys.groupBy("cov_key").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("cov_key", "line").agg(saturated(F.col("hits")).alias("hits"))


def _candidates(parts: Column, package: Column) -> Column:
    names = F.filter(F.split(F.coalesce(package, F.lit("")), "/"), lambda p: p != "")
    whole = F.when((F.size(parts) > 1) & (F.size(names) > 0), F.array(F.concat(names, parts))).otherwise(F.array().cast("array<array<string>>"))
    last = F.when((F.size(parts) > 1) & (F.size(names) > 1), F.array(F.concat(F.slice(names, -1, 1), parts))).otherwise(F.array().cast("array<array<string>>"))
    return F.array_distinct(F.concat(F.array(parts), whole, last))


def _strong(key: Column, names: Column) -> Column:
    one = F.get(names, F.lit(0))
    rooted = F.exists(F.sequence(F.lit(0), F.size(key)), lambda i: (F.get(key, i) == one) & F.get(key, i + 1).isin(*ROOTS))
    # a suffix of a longer name begins with its last part, so that part alone decides
    return F.when(F.size(names) == 1, F.coalesce(rooted, F.lit(False))).when(F.size(names) > 1, F.array_contains(key, F.element_at(names, -1))).otherwise(False)


def _weak(key: Column, names: Column) -> Column:
    return F.when(F.size(names) > 0, F.array_contains(key, F.get(names, F.size(names) - 1))).otherwise(False)


def resolve(sources: DataFrame, keys: DataFrame) -> DataFrame:
    """(file, package, cov_key, status): once for each distinct source file and package; null cov_key if not found.

    ``keys``: what :func:`coverage_keys` gives.
    """
    files = keys.select("cov_key", "cov_parts", F.element_at("cov_parts", -1).alias("base")).dropDuplicates(["cov_key"])
    src = sources.select("file", "package").distinct().withColumn("parts", components(F.col("file")))
    cand = src.select("file", "package", F.element_at(F.when(F.size("parts") > 0, F.col("parts")), -1).alias("base"), F.explode(_candidates(F.col("parts"), F.col("package"))).alias("cand"))
    pairs = cand.join(files, "base").where(is_suffix_pair(F.col("cand"), F.col("cov_parts")))
    rank = F.struct((F.size("cov_parts") <= F.size("cand")).alias("ends"), F.least(F.size("cov_parts"), F.size("cand")).alias("len"), (F.col("cov_parts") == F.col("cand")).alias("exact"))
    names = F.filter(F.split(F.coalesce("package", F.lit("")), "/"), lambda p: p != "")
    hit = F.struct("cov_key", _strong(F.col("cov_parts"), names).alias("strong"), _weak(F.col("cov_parts"), names).alias("weak"))
    # one aggregate: the best rank, then the set of its keys (as many as tie, not as many as there are files)
    best = pairs.groupBy("file", "package", rank.alias("rank")).agg(F.collect_set(hit).alias("hits")).groupBy("file", "package").agg(F.max_by("hits", "rank").alias("hits"))
    strong = F.filter("hits", lambda h: h["strong"])
    weak = F.filter("hits", lambda h: h["weak"])
    chosen = F.when(F.size("hits") == 1, F.get("hits", F.lit(0))["cov_key"]).when(F.size(strong) == 1, F.get(strong, F.lit(0))["cov_key"]).when(F.size(weak) == 1, F.get(weak, F.lit(0))["cov_key"])
    found = best.select(F.col("file").alias("f"), F.col("package").alias("p"), chosen.alias("cov_key"))
    on = (F.col("file") == F.col("f")) & F.col("package").eqNullSafe(F.col("p"))
    status = F.when(F.col("f").isNull(), "missing").when(F.col("cov_key").isNull(), "ambiguous").otherwise("found")
    return src.join(found, on, "left").select("file", "package", "cov_key", status.alias("status"))
