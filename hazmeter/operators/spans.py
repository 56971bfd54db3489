"""Coverage of function spans: a range join with nested functions taken out, then policy, score and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazmeter.functions import score
from hazmeter.functions.paths import components, sort_key
from hazmeter.model import Missing
from hazmeter.operators.resolve import coverage_keys, normalised, resolve
from hazmeter.sources.lcov import saturated
from hazmeter.staging import stage

#: Lines in one bucket of the range join's second key.
BUCKET = 256


def merge_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi): ranges of a key that overlap or touch, joined. Spans of one file are one task's work."""
    w = Window.partitionBy(key).orderBy("lo", "hi")
    prev = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.select(key, "lo", "hi", F.when(prev.isNull() | (F.col("lo") > prev + 1), 1).otherwise(0).alias("new"))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def covered_lines(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """(fid, line, hits): the coverage lines in each function's span, less those in functions strictly inside it.

    ``functions``: fid, peer (normalised file), cov_key, start_line, end_line. The join's keys are the file and a
    bucket of lines, so a long file is spread over tasks.
    """
    buckets = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BUCKET), F.floor(hi / BUCKET)))
    f = functions.where("start_line <= end_line").select("fid", "peer", "cov_key", "start_line", "end_line", buckets(F.col("start_line"), F.col("end_line")).alias("bucket"))
    inside = f.where(F.col("cov_key").isNotNull()).join(lines.withColumn("bucket", F.floor(F.col("line") / BUCKET)), ["cov_key", "bucket"]).where("line BETWEEN start_line AND end_line")
    inner = f.select("peer", "bucket", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    nested = (
        (F.col("a.peer") == F.col("b.peer")) & (F.col("a.bucket") == F.col("b.bucket")) & F.col("a.line").between(F.col("b.lo"), F.col("b.hi"))
        & (F.col("b.lo") >= F.col("a.start_line")) & (F.col("b.hi") <= F.col("a.end_line")) & (F.col("b.hi") - F.col("b.lo") < F.col("a.end_line") - F.col("a.start_line"))
    )
    return inside.alias("a").join(inner.alias("b"), nested, "left_anti").select("fid", "line", "hits")


def join_coverage(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """``functions`` with coverage_join and, where measured, coverage in per cent; no policy is applied yet.

    ``functions``: seq, file, function, start_line, end_line, complexity, crate_name, join_key; ``lines``: path, line,
    hits, lines of a path repeated or not. The coverage is read once: its lines, summed up, and the small map from files
    to keys are staged, and every later step reads these.
    """
    held = stage(lines.groupBy("path", "line").agg(saturated(F.col("hits")).alias("hits")), "lines")
    fs = functions.withColumn("fid", F.col("seq")).withColumn("package", F.coalesce("join_key", "crate_name"))
    keys = stage(coverage_keys(held), "keys")
    peer = F.array_join(components(F.col("file")), "/").alias("peer")
    found = stage(resolve(fs, keys).select(F.col("file").alias("f"), F.col("package").alias("p"), peer, "cov_key", "status"), "resolved")
    fs = fs.join(found, (F.col("file") == F.col("f")) & F.col("package").eqNullSafe(F.col("p"))).drop("f", "p")
    hits = covered_lines(fs, normalised(held, keys)).groupBy("fid").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hits") > 0).alias("covered"))
    rows = fs.join(hits, "fid", "left")
    join = F.when(F.col("status") == "ambiguous", "ambiguous").when((F.col("status") == "found") & (F.col("total") > 0), "measured").otherwise("missing")
    measured = F.when(join == "measured", F.col("covered") / F.col("total") * 100.0)
    return rows.select("seq", "file", "function", "start_line", "end_line", "complexity", "crate_name", join.alias("coverage_join"), measured.alias("coverage"))


def apply_policy(rows: DataFrame, missing: Missing) -> DataFrame:
    """Coverage where none was measured, or no row: ``coverage`` is full afterwards."""
    if missing is Missing.SKIP:
        return rows.where("coverage_join = 'measured'")
    return rows.withColumn("coverage", F.coalesce("coverage", F.lit(0.0 if missing is Missing.PESSIMISTIC else 100.0)))


def score_functions(functions: DataFrame, lines: DataFrame, missing: Missing = Missing.PESSIMISTIC) -> DataFrame:
    """The scored rows, in no order: :func:`join_coverage`, policy and score."""
    rows = apply_policy(join_coverage(functions, lines), missing)
    return rows.select("seq", "file", "function", "start_line", "end_line", "complexity", "coverage", "coverage_join", score.crap(F.col("complexity"), F.col("coverage")).alias("crap"), "crate_name")


def ordered(scored: DataFrame) -> DataFrame:
    """Worst first, then by path component, line and order of collection."""
    return scored.orderBy(F.col("crap").desc(), sort_key(F.col("file")).asc(), F.col("start_line").asc(), F.col("seq").asc())
