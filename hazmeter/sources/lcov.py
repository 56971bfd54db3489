"""LCOV as a table: records in order, the file each one belongs to, hits summed by line.

What a ``DA`` record means depends on the lines before it only back to the last ``end_of_record``, and there on the
last ``SF``. So a text is split at the first and then at the second, and no window over a whole file is needed. Files
are read by records, so a profile of any size is spread over tasks; a file that holds the end mark in any other place
than a line of its own is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmeter.model import CoverageError

U64 = (1 << 64) - 1
U32 = (1 << 32) - 1
#: What is trimmed: the white space of Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_IN_LINE = "[" + SPACE.replace("\n", "") + "]*"
_END = f"(?md)^{_IN_LINE}end_of_record{_IN_LINE}$"
_FILE = f"(?md)^{_IN_LINE}SF:"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def unsigned(text: Column, top: int) -> Column:
    """Decimal value of an unsigned number without blanks, null if it is none or over ``top``."""
    value = F.when(text.rlike(r"^\+?[0-9]{1,60}$"), text.try_cast("decimal(38,0)"))
    return F.when(value <= F.lit(str(top)).cast("decimal(38,0)"), value).cast("decimal(20,0)")


def saturated(hits: Column) -> Column:
    """Sum that stays within 64 bits."""
    return F.least(F.sum(hits), F.lit(str(U64)).cast("decimal(38,0)")).cast("decimal(20,0)")


def records(texts: DataFrame) -> DataFrame:
    """(source, pos, path, line, hits, error): the DA records of (source, text), errors instead of values where invalid.

    ``texts`` may hold a file in several rows, cut at its records, with a column ``piece`` that orders them. ``pos``
    (an array) orders the records of a source. Bytes that are no UTF-8 are an error. Null texts hold nothing.
    """
    piece = F.col("piece") if "piece" in texts.columns else F.lit(0).cast("long").alias("piece")
    rows = texts.select("source", piece, F.posexplode(F.split(F.when(F.is_valid_utf8("text"), F.col("text")).otherwise("SF:-\nDA:not UTF-8"), _END)).alias("rec", "text"))
    rows = rows.select("source", "piece", "rec", F.posexplode(F.split("text", _FILE)).alias("sec", "text"))
    # the first section of a record stands before any SF; in the others the first line is the file
    cut = F.instr("text", "\n")
    path = F.when(F.col("sec") > 0, F.replace(trimmed(F.when(cut > 0, F.expr("left(text, instr(text, '\n') - 1)")).otherwise(F.col("text"))), F.lit("\\"), F.lit("/")))
    rows = rows.where(F.contains("text", F.lit("DA:"))).select("source", "piece", "rec", "sec", path.alias("path"), F.posexplode(F.split("text", "\n")).alias("ln", "s"))
    rows = rows.where((F.col("sec") == 0) | (F.col("ln") > 0)).withColumn("s", trimmed(F.col("s"))).where(F.col("s").startswith("DA:"))
    fields = F.split(F.substring("s", 4, 1 << 30), ",")
    # bound once: the parsed numbers are named again in the error
    parsed = F.struct(unsigned(F.get(fields, F.lit(0)), U32).cast("long").alias("line"), unsigned(F.get(fields, F.lit(1)), U64).alias("hits"))
    pos = F.array("piece", F.col("rec").cast("long"), F.col("sec").cast("long"), F.col("ln").cast("long"))
    da = rows.select("source", pos.alias("pos"), "s", "path", F.explode(F.array(parsed)).alias("n")).select("source", "pos", "s", "path", "n.line", "n.hits")
    error = F.when(F.col("path").isNull(), F.concat(F.lit("DA record without SF: "), "s")).when(F.col("line").isNull() | F.col("hits").isNull(), F.concat(F.lit("malformed DA record: "), "s"))
    return da.select("source", "pos", "path", "line", "hits", error.alias("error"))


def coverage_lines(recs: DataFrame) -> DataFrame:
    return recs.where(F.col("error").isNull()).groupBy("path", "line").agg(saturated(F.col("hits")).alias("hits"))


def merge(*tables: DataFrame) -> DataFrame:
    """The union of coverage tables, hits of one line added up."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("path", "line").agg(saturated(F.col("hits")).alias("hits"))


def verdicts(recs: DataFrame) -> DataFrame:
    """(source, n, error): the valid records of each source and its first error in order."""
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("pos", "error")))["error"]
    return recs.groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("n"), first.alias("error"))


def first_error(recs: DataFrame) -> tuple[int, str | None]:
    """(valid records, first error by source) in one action."""
    r = verdicts(recs).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min(F.when(F.col("error").isNotNull(), F.struct("source", "error"))).alias("e")).first()
    return r["n"], f"{r['e']['source']}: {r['e']['error']}" if r["e"] else None


def parse_text(spark: SparkSession, text: str) -> tuple[DataFrame, int]:
    """Coverage of a text and the number of its DA records, none allowed."""
    recs = records(spark.createDataFrame([("<bytes>", text)], "source string, text string"))
    n, error = first_error(recs)
    if error:
        raise CoverageError(error)
    return coverage_lines(recs), n


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(source, piece, text) of LCOV files, cut behind each record."""
    rows = spark.read.option("lineSep", "end_of_record").text(path).select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("piece"), F.col("value").alias("text"))
    # the mark is a record's end if blanks alone share its line; a first piece begins with a record, not with a rest
    head, tail = trimmed(F.substring_index("text", "\n", 1)), trimmed(F.substring_index("text", "\n", -1))
    odd = (tail != "") | (head != "") & ~head.startswith("TN:") & ~head.startswith("SF:")
    whole = rows.where(odd).select("source").distinct()
    if whole.isEmpty():
        return rows
    again = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.lit(0).cast("long").alias("piece"), F.col("value").alias("text"))
    return rows.join(whole, "source", "left_anti").unionByName(again.join(whole, "source", "left_semi"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Coverage of LCOV files; a malformed record or a file set without any record is an error."""
    recs = records(pieces(spark, path))
    n, error = first_error(recs)
    if error or not n:
        raise CoverageError(error or f"{path}: LCOV has no valid line-hit (DA) records")
    return coverage_lines(recs)
