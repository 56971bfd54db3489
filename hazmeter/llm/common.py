"""Shared pieces: staged tables in the shared folder, row naming by one global sort, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazmeter.staging import drop_staged, scratch, shared_dir, stage  # noqa: F401  the operators take them from here

def name_runs(df: DataFrame, route: str, keys: list[str], order: list[str], label: str, repeats_only: bool = False) -> DataFrame:
    """Give equal keys one integer name by sorting, without gathering any key in one task.

    ``route`` is a long column that depends on the keys alone. Rows are range-partitioned on (route, order), so
    a key with a third of all rows spreads over many partitions; each partition is sorted and numbered. A key
    that crosses partitions gets several names, which the edge rows (the first and last route of each partition)
    bring back to the smallest one. Returns the columns of ``df`` but the keys and the route, with ``name`` (long)
    and ``is_first`` (boolean: the first row of its key in the order); with ``repeats_only`` the rows that are not
    first in theirs, and perhaps a few that are. The route may be a key itself.
    """
    kept = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name not in keys and f.name != route]
    key_fields = [df.schema[k] for k in keys]
    out = T.StructType([*kept, T.StructField("name", T.LongType()), T.StructField("is_first", T.BooleanType()), T.StructField("edge", T.BooleanType()), T.StructField("edge_route", T.LongType()), *[T.StructField("edge_" + f.name, f.dataType) for f in key_fields]])
    arrow = None

    def number(batches):
        nonlocal arrow
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        pid, rank, last = TaskContext.get().partitionId() << 33, -1, None
        first_route = last_route = None
        at_first: dict = {}  # names of the first and the last route, with route and key
        at_last: dict = {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols = [b.column(k) for k in keys]
            new = np.zeros(n, dtype=bool)
            for c in cols:
                if n > 1:
                    new[1:] |= _differs(c.slice(1), c.slice(0, n - 1))
            new[0] = last is None or any(c[0].as_py() != x for c, x in zip(cols, last))
            ranks = rank + np.cumsum(new)
            rank, last = int(ranks[-1]), [c[n - 1].as_py() for c in cols]
            routes = b.column(route)
            r = routes.to_numpy(zero_copy_only=False)
            data = [b.column(f.name) for f in kept] + [pa.array(pid + ranks), pa.array(new), pa.array(np.zeros(n, dtype=bool)), pa.nulls(n, pa.int64()), *[pa.nulls(n, c.type) for c in cols]]
            batch = pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(data, arrow)], schema=arrow)
            yield batch.filter(pa.array(~new | (ranks == 0))) if repeats_only else batch
            if first_route is None:
                first_route = int(r[0])
            if int(r[-1]) != last_route:
                at_last, last_route = {}, int(r[-1])
            starts = np.flatnonzero(new)
            for edge, at in ((first_route, at_first), (last_route, at_last)):
                for i in starts[r[starts] == edge].tolist():
                    at[pid + int(ranks[i])] = (edge, [c[i].as_py() for c in cols])
        held = [(n, *x) for n, x in (at_first | at_last).items()]
        if held:
            m = len(held)
            data = [pa.nulls(m, f.type) for f in list(arrow)[: len(kept)]]
            data += [pa.array([h[0] for h in held], pa.int64()), pa.nulls(m, pa.bool_()), pa.array([True] * m), pa.array([h[1] for h in held], pa.int64())]
            data += [pa.array([h[2][i] for h in held], list(arrow)[len(kept) + 4 + i].type) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays(data, schema=arrow)

    ranged = df.repartitionByRange(route, *order).sortWithinPartitions(route, *keys, *order)
    rows = stage(ranged.mapInArrow(number, out), label)
    edges = rows.where("edge").select("name", "edge_route", *["edge_" + k for k in keys])
    same = ["edge_route", *["edge_" + k for k in keys]]
    # at most a few edge rows a partition, so this stays small whatever the input
    least = edges.groupBy(*same).agg(F.min("name").alias("canon"), F.max("name").alias("top"), F.collect_set("name").alias("all")).where("canon < top")
    fixes = least.select("canon", F.explode("all").alias("other")).where("other > canon")
    fixes = stage(fixes, label + "-edges")
    if fixes.isEmpty():
        return rows.where("not edge").drop("edge", *same)
    return rows.where("not edge").join(fixes, F.col("name") == F.col("other"), "left").select(
        *[f.name for f in kept], F.coalesce("canon", "name").alias("name"), (F.col("is_first") & F.col("canon").isNull()).alias("is_first")
    )


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays differ, nulls counting as equal to each other."""
    import pyarrow.compute as pc

    x = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if a.null_count or b.null_count:
        x = x | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return x


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of an undirected graph given as (u long, v long): (node, comp), comp the smallest node.

    Each round hooks every node to its smallest neighbour, jumps pointers to the roots and contracts the graph;
    every component at least halves, so rounds grow with the logarithm of its size. Joins read staged tables on
    both sides, so that adaptive execution can split a hub. Nodes without an edge do not appear.
    """
    e = stage(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), label + "-e")
    labels = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), label + "-p")
        while True:
            up = p.select(F.col("node").alias("mid"), F.col("comp").alias("top"))
            q = stage(p.join(up, F.col("comp") == F.col("mid"), "left").select("node", F.coalesce("top", "comp").alias("comp"), (F.col("top") < F.col("comp")).alias("moved")), label + "-p")
            moved = not q.where("moved").isEmpty()
            p = q.select("node", "comp")
            if not moved:
                break
        if labels is None:
            labels = p
        else:
            up = p.select(F.col("node").alias("mid"), F.col("comp").alias("top"))
            labels = stage(labels.join(up, F.col("comp") == F.col("mid"), "left").select("node", F.coalesce("top", "comp").alias("comp")), label + "-l")
        a = p.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
        b = p.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
        e = stage(e.join(a, "u").join(b, "v").where("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct(), label + "-e")
    if labels is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    # the root of a contracted tree is its smallest node, as pointers only ever lead downwards
    return labels


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
