"""Exact deduplication by deterministic block naming.

Every text is cut into fixed-size blocks of code points. The blocks of all documents are sorted and named by
integers, equal blocks by the same one. Then adjacent pairs of names are named in the same way, level by level,
until each document has a single name. Two documents have the same (level, name) exactly when their texts are
identical: no hash stands for a text anywhere, so nothing can collide.

Cost: one shuffle of the text, then tables of integers that shrink at least by half each level; levels grow with
the logarithm of the longest text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, name_runs, scratch, stage

#: Code points of a block.
BLOCK = 4096


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(rid, doc_id, text_sha256, level, name): one row per row of ``docs``; equal (level, name) mean equal texts.

    Null text counts as empty; the empty text is one empty block. Null and repeated ids stay separate rows.
    Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text.alias("text"))
    base = base.select("rid", "doc_id", F.sha2("text", 256).alias("sha"), "text", F.greatest(F.lit(1), F.ceil(F.length("text") / block)).cast("int").alias("n"))
    cut = base.select("rid", "doc_id", "sha", "n", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    first = F.col("pos") == 0
    cut = cut.select(
        "rid", "pos", "n", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.unhex("sha")).alias("sha"),
        F.expr(f"substring(text, pos * {int(block)} + 1, {int(block)})").alias("block"),
    )
    named = stage(name_runs(cut.withColumn("route", F.xxhash64("block")), "route", ["block"], ["rid", "pos"], "blocks"), "named")
    heads = named.where("pos = 0").select("rid", "doc_id", F.lower(F.hex("sha")).alias("text_sha256"), "n")
    level, done, rest = 0, [], named.select("rid", "pos", "n", "name")
    while True:
        done.append(rest.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        rest = rest.where("n > 1")
        if rest.isEmpty():
            break
        level += 1
        # a name with no right neighbour is paired with -1, which names nothing
        pairs = rest.groupBy("rid", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"), F.max(F.expr("(n + 1) div 2").cast("int")).alias("n")
        )
        pairs = pairs.withColumn("route", F.xxhash64("a", "b"))
        rest = stage(name_runs(pairs, "route", ["a", "b"], ["rid", "pos"], "pairs").select("rid", "pos", "n", "name"), "level")
    if level == 0:
        return named.select("rid", "doc_id", F.lower(F.hex("sha")).alias("text_sha256"), F.lit(0).alias("level"), "name")
    names = done[0]
    for d in done[1:]:
        names = names.unionByName(d)
    return heads.drop("n").join(names, "rid")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The largest id of equal texts stays, a null id only if the group has no other; among rows that repeat this
    id with the same text, one stays. An empty table gives an empty result.
    """
    ids = stage(identities(docs, id_col, text_col, block), "identities")
    # of repeated rows with the largest id, the smallest rid stays
    top = F.max(F.struct(F.col("doc_id").alias("id"), (-F.col("rid")).alias("r")))
    groups = stage(ids.groupBy("level", "name").agg(top.alias("top"), F.count(F.lit(1)).alias("group_size")), "groups")
    joined = ids.join(groups, ["level", "name"])
    return joined.select("doc_id", F.col("top.id").alias("keep_id"), "group_size", (F.col("rid") == -F.col("top.r")).alias("kept"), "text_sha256")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, all columns kept, whatever their names.

    Rows are matched by (id, digest of the text); where a row is repeated with id and text, one copy stays.
    """
    with scratch(docs.sparkSession) as keep:
        kept = keep(exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")), "kept")
    names, inner = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    of = lambda c: F.col(inner[names.index(c)])
    rows = docs.toDF(*inner).withColumn("sha", F.sha2(F.coalesce(of(text_col).cast("string"), F.lit("")), 256))
    found = rows.join(kept, of(id_col).eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    if not docs.groupBy(F.col(id_col)).count().where("count > 1").isEmpty():
        found = found.dropDuplicates([inner[names.index(id_col)], "sha"])
    return found.select(*inner).toDF(*names)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP7_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
