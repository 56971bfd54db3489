"""Near-duplicate detection: 64-bit SimHash fingerprints linked through a Gray-order hierarchical index.

Fingerprints are computed in numpy. To find all pairs at ``radius`` or fewer differing bits, the 64 bits are cut
into radius + 1 bands; two linked fingerprints agree in one band at least, so (band, value) cells are the upper
nodes of the index: a mask and the bit pattern that all members share. A cell with more members than a task should
hold is cut in the same way over the bits that are still free, so that no cell is unbounded and no pair is lost.
Within a cell, members are sorted by Gray rank, runs of neighbours form the lower nodes, and each node keeps only
the bits in which its members agree and its parent's do not. A search walks down from the cell, adds up the
differences from each node's pattern and drops a whole node as soon as the sum exceeds the radius.

Cells send one link a member at most (to the smallest fingerprint it reaches in its cell), not all pairs; a
component search over these links gives the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, stage

RADIUS = 3
SHINGLE = 3
#: Members of a cell that one task searches at once; larger cells are cut further.
CELL = 16_384
#: Children of an index node.
FAN = 16


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """SimHash of one text. Bytes split and fold as asked: only A-Z change case, only ASCII blanks separate words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < k:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(k))))
    h64 = xxhash.xxh64_intdigest
    return majority(np.fromiter((h64(s, 42) for s in shingles), dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):  # very long texts in pieces
        part = hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every row; the long holds the 64 bits."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, k) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence: the prefix sums of its bits, modulo two."""
    f = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        f ^= f >> np.uint64(s)
    return f


def search(cells: np.ndarray, fps: np.ndarray, radius: int = RADIUS, budget: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i before j in the given order of rows, within ``radius`` bits and in one cell."""
    i, j = zip(*_search(cells, fps, radius, budget))
    return np.concatenate(i), np.concatenate(j)


def _search(cells: np.ndarray, fps: np.ndarray, radius: int, budget: int = 4_000_000):
    """The pairs of :func:`search`, some rows i at a time.

    Rows must be sorted by cell and Gray rank, distinct within a cell. ``budget`` bounds the leaves looked at once.
    """
    n = len(fps)
    levels = []  # from the leaves' parents upwards: first child, end child, and-pattern, or-pattern, first leaf, end leaf
    lo_and, lo_or, owner, first, end = fps, fps, cells, np.arange(n), np.arange(1, n + 1)
    while True:
        m = len(owner)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, m])
        if levels and (sizes == 1).all():
            break
        begin = np.repeat(starts, -(-sizes // FAN))
        within = np.arange(len(begin)) - np.repeat(np.cumsum(np.r_[0, -(-sizes // FAN)])[:-1], -(-sizes // FAN))
        begin = begin + within * FAN
        stop = np.r_[begin[1:], m]
        lo_and, lo_or = np.bitwise_and.reduceat(lo_and, begin), np.bitwise_or.reduceat(lo_or, begin)
        first, end, owner = first[begin], end[stop - 1], owner[begin]
        levels.append((begin, stop, ~(lo_and ^ lo_or), lo_and, first, end))
    top = levels[-1]
    sizes = top[5] - top[4]
    roots = np.repeat(np.arange(len(sizes)), sizes)  # of each row
    cost = np.cumsum(sizes[roots])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + budget, "right")))
        q, node = np.arange(at, to), roots[at:to]
        at = to
        acc = np.bitwise_count((fps[q] ^ top[3][node]) & top[2][node]).astype(np.int16)
        for depth in range(len(levels) - 1, -1, -1):
            begin, stop, mask, _, _, _ = levels[depth]
            k = stop[node] - begin[node]
            child = np.repeat(begin[node] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(int(k.sum()))
            q, acc, free = np.repeat(q, k), np.repeat(acc, k), ~np.repeat(mask[node], k)
            if depth:
                below = levels[depth - 1]
                keep = below[5][child] > q + 1  # a node wholly before the query has had its turn
                q, acc, free, child = q[keep], acc[keep], free[keep], child[keep]
                acc = acc + np.bitwise_count((fps[q] ^ below[3][child]) & below[2][child] & free)
            else:
                keep = child > q
                q, acc, free, child = q[keep], acc[keep], free[keep], child[keep]
                acc = acc + np.bitwise_count((fps[q] ^ fps[child]) & free)
            keep = acc <= radius
            q, acc, node = q[keep], acc[keep], child[keep]
        yield q, node


def _nearest(cells: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of :func:`search` the one with the least differing bits for each j, once for each range of i."""
    out = []
    for i, j in _search(cells, fps, radius):
        order = np.lexsort((np.bitwise_count(fps[i] ^ fps[j]), j))
        order = order[np.r_[True, j[order][1:] != j[order][:-1]]] if len(order) else order
        out.append((i[order], j[order]))
    i, j = zip(*out)
    return np.concatenate(i), np.concatenate(j)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches over the pairs."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _link(batches, radius: int, nearest: bool = False):
    """Links of whole cells, ``nearest``: pairs within the radius. Rows come sorted by cell; what may go on in the next batch waits."""
    held_c, held_f = [], []
    size = 0

    def flush(c, f):
        f = f.view(np.uint64)
        order = np.lexsort((gray_rank(f), c))
        c, f = c[order], f[order]
        same = np.r_[False, (c[1:] == c[:-1]) & (f[1:] == f[:-1])]  # two paths into one cell
        c, f = c[~same], f[~same]
        i, j = (_nearest if nearest else search)(c, f, radius)
        if not len(i):
            return None
        if nearest:
            return pa.RecordBatch.from_arrays([pa.array(f[i].view(np.int64)), pa.array(f[j].view(np.int64))], names=["u", "v"])
        root = _roots(len(f), i, j)
        on = np.flatnonzero(root != np.arange(len(f)))
        return pa.RecordBatch.from_arrays([pa.array(f[on].view(np.int64)), pa.array(f[root[on]].view(np.int64))], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        held_c.append(b.column(0).to_numpy(zero_copy_only=False))
        held_f.append(b.column(1).to_numpy(zero_copy_only=False))
        size += b.num_rows
        if size >= 131_072:
            c, f = np.concatenate(held_c), np.concatenate(held_f)
            cut = int(np.searchsorted(c, c[-1], "left"))
            if cut:
                out = flush(c[:cut], f[:cut])
                if out is not None:
                    yield out
            held_c, held_f, size = [c[cut:]], [f[cut:]], len(c) - cut
    if size:
        out = flush(np.concatenate(held_c), np.concatenate(held_f))
        if out is not None:
            yield out


def _pieces(parts: int, depth: int) -> list[list[int]]:
    """The 64 bits in ``parts`` pieces, otherwise at each depth, so that deeper cells share ever more bits."""
    bits = list(range(64))
    if 1 <= depth <= 2:
        bits.sort(key=lambda b: b % (16 // 4 ** (depth - 1)))
    elif depth:
        bits = np.random.default_rng(depth).permutation(64).tolist()
    return [x.tolist() for x in np.array_split(bits, parts)]


def _pick(bits: list[int]) -> int:
    """The mask of the given bits as a signed 64-bit number."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _children(rows: DataFrame, parts: int, depth: int) -> DataFrame:
    """Each member once for each piece: members of a child cell agree in the piece's bits too."""
    options = [F.xxhash64("cell", F.lit(depth * parts + i), F.col("fp").bitwiseAND(F.lit(_pick(p)).cast("long"))) for i, p in enumerate(_pieces(parts, depth))]
    return rows.select(F.explode(F.array(*options)).alias("cell"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, cell: int = CELL, depths: int = 12, nearest: bool = False) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect all those within ``radius`` bits of each other.

    ``nearest``: the links are pairs within the radius, to be verified, from each fingerprint in each of its cells to
    the nearest one before it; some may be given twice.
    ``fps``: distinct ``fp`` (long). Cells over ``cell`` members are cut again by other bits, ``depths`` times at
    most; after three times 37 bits are shared. A cell that is still large is searched all the same.
    """
    parts = radius + 1
    rows, found = _children(fps.select(F.lit(0).cast("long").alias("cell"), "fp"), parts, 0), None
    for depth in range(1, depths + 1):
        heavy = stage(rows.groupBy("cell").count().where(F.col("count") > cell).select("cell"), "cells")
        if last := depth == depths or heavy.isEmpty():
            out = rows
        else:
            kept = stage(rows, "members")
            out, rows = kept.join(heavy, "cell", "left_anti"), _children(kept.join(heavy, "cell"), parts, depth)
        out = out.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda it: _link(it, radius, nearest), "u long, v long")
        found = out if found is None else found.unionByName(out)
        if last:
            break
    return found


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``; component_id is the smallest id reachable over links.

    Null and blank texts have fingerprint zero and link like any other. A row without an id takes part in links,
    and its group is named by the smallest id it has (null if none has one).
    """
    fp = stage(fingerprints(docs, id_col, text_col, k), "fp")
    least = stage(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-least")
    comp = components(links(least.select("fp"), radius, cell), "simhash")
    named = stage(least.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp")), "fp-comp")
    ids = stage(named.groupBy("comp").agg(F.min("least").alias("component_id")), "comp-id")
    by_fp = stage(named.join(ids, "comp").select("fp", "component_id"), "fp-id")
    return fp.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
