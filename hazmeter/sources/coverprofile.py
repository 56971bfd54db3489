"""Go coverprofiles as a table: blocks checked, spread over their lines, any zero-hit block wins its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmeter.model import CoverageError
from hazmeter.sources.lcov import U32, U64, saturated, trimmed, unsigned

#: A block of so many lines is malformed.
SPAN = 1_000_000
#: Path up to the last colon before the span; of a place the line alone is read; fields are parted by single blanks.
_FIELDS = r"(?s)^(.*):([^:,.]*)\.[^:,]*,([^:.]*)\.[^:]* ([^ ]*) ([^ ]*)$"


def _mode(line: Column) -> Column:
    """Mode of a profile's first line, null if it names none."""
    line = trimmed(line)
    name = F.when(line.startswith("mode:"), trimmed(F.substring(line, 6, 1 << 30)))
    return F.when(name == "set", "set").when(name.isin("count", "atomic"), "count")


def _parsed(rows: DataFrame) -> DataFrame:
    """Adds path, start_line, end_line, stmts, hits and error to (source, pos, mode, s); ``pos`` 0 is the header."""
    # bound once: the parsed fields are named often below
    texts = F.struct(*[F.regexp_extract("s", _FIELDS, i).alias(f"p{i}") for i in range(1, 6)], F.col("s").rlike(_FIELDS).alias("ok"))
    fields = F.get(F.transform(F.array(texts), lambda p: F.struct(
        F.when(p["ok"], F.replace(p["p1"], F.lit("\\"), F.lit("/"))).alias("path"), unsigned(p["p2"], U32).cast("long").alias("start_line"), unsigned(p["p3"], U32).cast("long").alias("end_line"),
        unsigned(p["p4"], U64).alias("stmts"), unsigned(p["p5"], U64).alias("hits"),
    )), F.lit(0))
    out = rows.select("source", "pos", "mode", "s", F.explode(F.array(fields)).alias("f")).select("source", "pos", "mode", "s", "f.*")
    valid = F.col("path").isNotNull() & F.col("stmts").isNotNull() & F.col("hits").isNotNull() & (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") - F.col("start_line") < SPAN)
    wrong = (F.col("pos") > 0) & ~F.coalesce(valid, F.lit(False))
    error = F.when(~F.is_valid_utf8("s"), F.lit("not UTF-8")).when(F.col("mode").isNull(), F.lit("missing or unknown coverprofile mode")).when(wrong, F.concat(F.lit("malformed coverprofile line: "), "s"))
    return out.withColumn("error", error).drop("s")


def blocks(texts: DataFrame) -> DataFrame:
    """(source, pos, mode, path, start_line, end_line, stmts, hits, error) of (source, text).

    The first line is the mode; blank lines are skipped; everything else must be a block.
    """
    rows = texts.select("source", _mode(F.element_at(F.split("text", "\n"), 1)).alias("mode"), F.posexplode(F.split("text", "\n")).alias("pos", "s"))
    return _parsed(rows.withColumn("s", trimmed(F.col("s"))).where((F.col("pos") == 0) | (F.col("s") != "")))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`blocks`, for files of any size: they are read by lines, and the line that begins a file is its header."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("s"))
    heads = rows.where("block = 0").groupBy("source").agg(F.min(F.struct("id", "s")).alias("h")).select("source", F.col("h.id").alias("head"), _mode(F.col("h.s")).alias("mode"))
    rows = rows.join(heads, "source").select("source", F.when(F.col("id") == F.col("head"), F.lit(0).cast("long")).otherwise(F.col("id") + 1).alias("pos"), "mode", trimmed(F.col("s")).alias("s"))
    return _parsed(rows.where((F.col("pos") == 0) | (F.col("s") != "")))


def coverage_lines(found: DataFrame) -> DataFrame:
    """(path, line, hits) of valid blocks: spread after they were checked, merged line by line."""
    good = found.where(F.col("error").isNull() & (F.col("pos") > 0))
    lines = good.select("path", "mode", "hits", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    hits = F.when(F.max(F.col("hits") == 0), F.lit(0).cast("decimal(20,0)")).when(F.max("mode") == "set", F.lit(1).cast("decimal(20,0)")).otherwise(saturated(F.col("hits")))
    return lines.groupBy("path", "line").agg(hits.alias("hits"))


def remap(lines: DataFrame, modules: DataFrame) -> DataFrame:
    """Import paths as file paths: the longest module path that the path goes on from by a slash, else unchanged.

    ``modules``: module_path, module_root. Only distinct paths are matched, on prefixes cut at slashes, so this is an
    equi-join whatever the number of modules.
    """
    paths = lines.select("path").distinct()
    parts = F.split("path", "/")
    cut = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "/").alias("prefix")))).alias("c")).where(F.col("path").contains("/"))
    best = cut.join(modules, F.col("c.prefix") == F.col("module_path")).groupBy("path").agg(F.max_by(F.struct("module_root", "module_path"), F.length("module_path")).alias("m"))
    moved = F.when(F.col("m").isNull(), F.col("path")).otherwise(F.concat_ws("/", F.nullif("m.module_root", F.lit("")), F.expr("substring(path, length(m.module_path) + 2)")))
    return lines.join(best, "path", "left").select(moved.alias("path"), "line", "hits").groupBy("path", "line").agg(saturated(F.col("hits")).alias("hits"))


def load(found: DataFrame, modules: DataFrame | None, what: str) -> DataFrame:
    """Coverage of checked blocks, import paths mapped if there are modules; one malformed line fails them all."""
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("source", "pos", "error")))
    r = found.agg(F.count_if(F.col("pos") > 0).alias("n"), first.alias("e")).first()
    if r["e"] or not r["n"]:
        raise CoverageError(f"{r['e']['source']}: {r['e']['error']}" if r["e"] else f"{what}: coverprofile has no data lines")
    return remap(coverage_lines(found), modules) if modules is not None else coverage_lines(found)


def parse_text(spark: SparkSession, text: str, modules: DataFrame | None = None) -> DataFrame:
    return load(blocks(spark.createDataFrame([("<bytes>", text)], "source string, text string")), modules, "<bytes>")


def read(spark: SparkSession, path: str, modules: DataFrame | None = None) -> DataFrame:
    return load(lines_of(spark, path), modules, path)
