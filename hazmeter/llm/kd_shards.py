"""Sharding by a k-d tree, with DataFrame operations only.

Each document is a point; its coordinates are figures of its text (bytes, lines, bytes a character, characters a word,
share of digits), so equal texts never part. A node over the target bytes is split at the median of its bytes along the
dimension in which it is widest, measured by the range of all documents. Medians come from histograms over the node's
own range, of a fixed number of bins; a bin that holds too much is cut again at the next level, where it is a node with
a range of its own. Only where all figures of a node are equal does a hash of the text part its points, and a node of
equal texts alone stays whole. Leaves go to the shards in the tree's order, so that a shard is a region; a leaf of equal
texts that is larger than a shard's share has a shard to itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop_staged, stage

SHARDS = 8
#: Leaves aimed at in each shard.
LEAVES = 64
#: Bins of a node's histogram.
BINS = 256
#: Rows numbered by one task at a time, and the most such chunks a shard has.
CHUNK, CHUNKS = 4096, 65_536

#: Figures of the text, and last the hash.
DIMS = ("d0", "d1", "d2", "d3", "d4", "d5")


def _points(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    bytes_, chars = F.octet_length("text"), F.length("text")
    some = F.greatest(chars, F.lit(1))
    without = lambda marks: F.length(F.translate("text", marks, ""))
    return rows.select(
        "doc_id", (bytes_ + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("h"),
        F.log2(bytes_ + 1.0).alias("d0"), F.log2(chars - without("\n") + 1.0).alias("d1"), (bytes_ / some).alias("d2"), F.log2(chars / (chars - without(" \n\t") + 1.0) + 1.0).alias("d3"),
        ((chars - without("0123456789")) / some).alias("d4"), F.xxhash64("text").cast("double").alias("d5"),
    )


def _rows(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(f"{x!r}D" if isinstance(x, float) else f"{x}" for x in r) + ")" for r in rows) + f" AS t({names})")


def _along(dim: str) -> Column:
    return F.get(F.array(*DIMS), F.col(dim))


def split(points: DataFrame, target: int, ends: dict[str, tuple[float, float]]) -> tuple[DataFrame, list[tuple[int, str, int]]]:
    """(points with ``leaf``, leaves as (leaf, path from the root, bytes)).

    The driver gets, for each level, a row of sums for each open node and one with its cut: a node is open if it has
    over ``target`` bytes, so these are at most total / target rows, a figure that does not grow with the input.
    """
    spark = points.sparkSession
    level, paths, leaves, closed = points.withColumn("leaf", F.lit(1)), {1: ""}, [], []
    while True:
        sums = level.groupBy("leaf").agg(F.sum("size").alias("size"), *[f(d).alias(f.__name__ + d) for d in DIMS for f in (F.min, F.max)]).collect()
        wide = {}
        for r in sums:
            spans = [(r["max" + d] - r["min" + d]) / ((ends[d][1] - ends[d][0]) or 1.0) for d in DIMS]
            dim = max(range(len(DIMS) - 1), key=lambda k: spans[k])  # the first of several  # noqa: B023
            dim = dim if spans[dim] > 0 else len(DIMS) - 1
            if r["size"] > target and spans[dim] > 0:
                wide[r["leaf"]] = (dim, float(r["min" + DIMS[dim]]), float(r["max" + DIMS[dim]]))
            else:
                leaves.append((r["leaf"], paths[r["leaf"]], r["size"]))
        done = [r["leaf"] for r in sums if r["leaf"] not in wide]
        if done:
            closed.append(level.where(F.col("leaf").isin(done)))
        if not wide:
            break
        ranges = F.broadcast(_rows(spark, "node, dim, lo, hi", [(n, *x) for n, x in wide.items()]))
        live = level.join(ranges, F.col("leaf") == F.col("node"))
        at = _along("dim")
        bin_ = F.least(F.lit(BINS - 1), F.floor((at - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).cast("int")
        hist = live.groupBy("node", bin_.alias("bin")).agg(F.sum("size").alias("b"), F.max(at).alias("top"))
        w = Window.partitionBy("node").orderBy("bin")
        cum = hist.select("node", "top", F.sum("b").over(w).alias("low"), F.sum("b").over(Window.partitionBy("node")).alias("all"), F.lead("bin").over(w).alias("next"))
        # the bin's end nearest to half of the bytes; the last bin has no end
        cuts = cum.where("next IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.abs(F.col("low") * 2 - F.col("all")).alias("off"), "top")).alias("c")).select("node", "c.top").collect()
        table, fresh = [], max(paths) + 1
        for r in sorted(cuts, key=lambda r: paths[r["node"]]):
            n = r["node"]
            paths[fresh], paths[fresh + 1] = paths[n] + "0", paths[n] + "1"
            table.append((n, wide[n][0], float(r["top"]), fresh))
            fresh += 2
        moved = level.join(F.broadcast(_rows(spark, "node, dim, cut, low", table)), F.col("leaf") == F.col("node"))
        level = stage(moved.withColumn("leaf", F.col("low") + F.when(_along("dim") <= F.col("cut"), 0).otherwise(1)).select(*points.columns, "leaf"), "level")
    if not closed:
        return level, []
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out, leaves


def deal(leaves: list[tuple[int, str, int]], shards: int) -> list[tuple[int, int]]:
    """(leaf, shard): leaves in the tree's order fill the shards one after the other; one over its share stands alone."""
    left, free, alone = sorted(leaves, key=lambda x: x[1]), shards, []
    while free > 1:
        big = max(left, key=lambda x: x[2], default=None)
        if big is None or big[2] * free <= sum(x[2] for x in left):
            break
        alone.append(big)
        left.remove(big)
        free -= 1
    out = [(x[0], shards - 1 - k) for k, x in enumerate(alone)]
    shard, load, rest = 0, 0, sum(x[2] for x in left)
    for leaf, _, size in left:
        share = (load + rest) / (free - shard)
        if load and shard + 1 < free and load + size / 2 > share:
            shard, load = shard + 1, 0
        out.append((leaf, shard))
        load, rest = load + size, rest - size
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", leaves: int = LEAVES) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, leaf, shard, slot.

    Size is the text's UTF-8 bytes (a null text has none) plus one. Shards get near equal bytes, as far as groups of
    equal texts, which stay whole, allow. Slots number the rows of a shard from 0 without gaps, in an order that
    depends on the rows alone. Null ids and repeated rows are rows like any other; texts of any length are read whole;
    other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    points = stage(_points(docs, id_col, text_col), "points")
    ends = points.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), *[f(d).alias(f.__name__ + d) for d in DIMS for f in (F.min, F.max)]).first()
    rows, total = ends["n"], ends["size"] or 0
    placed, found = split(points, max(1, total // (shards * leaves)), {d: (ends["min" + d] or 0.0, ends["max" + d] or 0.0) for d in DIMS})
    table = _rows(spark, "node, shard", deal(found, shards) or [(0, 0)])
    chunks = min(CHUNKS, max(1, rows // CHUNK))
    placed = placed.join(F.broadcast(table), F.col("leaf") == F.col("node")).select("doc_id", "size", "text_crc32", "h", "leaf", "shard", F.pmod(F.xxhash64("doc_id", "h"), F.lit(chunks)).alias("chunk"))
    placed = stage(placed, "placed")
    drop_staged(points)
    # rows that repeat id and text are alike, so they are counted; only then are slots given out, a chunk at a time
    alike = placed.groupBy("shard", "chunk", "doc_id", "h", "size", "text_crc32", "leaf").agg(F.count(F.lit(1)).alias("times"))
    alike = stage(alike, "alike")
    before = Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    base = alike.groupBy(F.col("shard").alias("s"), F.col("chunk").alias("c")).agg(F.sum("times").alias("n")).select("s", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = stage(base, "bases")
    nth = F.sum("times").over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("times")
    first = alike.withColumn("nth", nth).join(base, (F.col("shard") == F.col("s")) & (F.col("chunk") == F.col("c"))).withColumn("first", F.col("base") + F.col("nth"))
    return first.select("doc_id", "size", "text_crc32", "leaf", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("times") - 1)).alias("slot"))


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
