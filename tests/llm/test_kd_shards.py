"""The k-d tree against one grown over plain lists, and the law of bytes."""

import math

from hazmeter.llm import kd_shards as kd
from hazmeter.llm import common, registry

from .conftest import table


def figures(text):
    n = len(text)
    size = len(text.encode())
    return [math.log2(size + 1), math.log2(text.count("\n") + 1), size / max(n, 1), math.log2(n / (sum(map(text.count, " \n\t")) + 1.0) + 1.0), sum(c in "0123456789" for c in text) / max(n, 1)]


def tree(texts, target):
    """Leaves as lists of indices, in order; hashes part none of these points."""
    points = [(figures(t), len(t.encode()) + 1) for t in texts]
    ends = [(min(p[0][d] for p in points), max(p[0][d] for p in points)) for d in range(5)]
    out = []

    def grow(rows):
        size = sum(points[i][1] for i in rows)
        spans = [(max(points[i][0][d] for i in rows) - min(points[i][0][d] for i in rows)) / ((ends[d][1] - ends[d][0]) or 1) for d in range(5)]
        d = spans.index(max(spans))
        if size <= target or spans[d] == 0:
            out.append(sorted(rows))
            return
        lo, hi = min(points[i][0][d] for i in rows), max(points[i][0][d] for i in rows)
        bins = {}
        for i in rows:
            bins.setdefault(min(kd.BINS - 1, math.floor((points[i][0][d] - lo) / (hi - lo) * kd.BINS)), []).append(i)
        best, low = None, 0
        for b in sorted(bins)[:-1]:
            low += sum(points[i][1] for i in bins[b])
            key = (abs(2 * low - size), max(points[i][0][d] for i in bins[b]))
            best = key if best is None else min(best, key)
        grow([i for i in rows if points[i][0][d] <= best[1]])
        grow([i for i in rows if points[i][0][d] > best[1]])

    grow(list(range(len(texts))))
    return out


def test_tree(spark):
    docs = {r.doc_id: r.text for r in common.documents(spark, "/root/testdata/sf0.001").collect()}
    got = kd.shard(table(spark, docs.items()), leaves=6).collect()
    total = sum(r.size for r in got)
    ids = sorted(docs)
    want = tree([docs[i] for i in ids], max(1, total // 48))
    leaves = {}
    for r in got:
        leaves.setdefault(r.leaf, []).append(r.doc_id)
    assert sorted(map(sorted, leaves.values())) == sorted(sorted(ids[i] for i in leaf) for leaf in want)
    # a shard is a run of leaves in the tree's order
    of = {i: r.shard for r in got for i in [r.doc_id]}
    runs = [of[ids[leaf[0]]] for leaf in want]
    assert runs == sorted(runs) and set(runs) == set(range(8))


def test_deal():
    leaves = [(k, format(k, "06b"), 10) for k in range(64)]
    shards = dict(kd.deal(leaves, 8))
    assert [sum(s == k for s in shards.values()) for k in range(8)] == [8] * 8
    big = dict(kd.deal([*leaves, (99, "1", 900)], 8))
    assert sum(s == big[99] for s in big.values()) == 1 and max(sum(s == k for s in big.values()) for k in range(8)) <= 10
    assert kd.deal([], 8) == [] and kd.deal([(1, "", 5)], 8) == [(1, 0)] or kd.deal([(1, "", 5)], 8) == [(1, 7)]


def test_odd_tables(spark, odd, empty):
    rows, df = odd
    out = kd.shard(df).toPandas()
    assert len(out) == len(rows) and sorted(out["size"]) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert (out.groupby("text_crc32").shard.nunique() == 1).all() and out.shard.between(0, 7).all()
    assert kd.shard(empty).count() == 0
    # texts with equal figures are parted by their hashes, equal ones never
    alike = kd.shard(table(spark, [(k, f"{'abcdefgh'[k % 8]}{'ijklmnop'[k // 8 % 8]}") for k in range(128)]), leaves=2).toPandas()
    assert alike.leaf.nunique() >= 16 and (alike.groupby("text_crc32").leaf.nunique() == 1).all()


def test_law(spark):
    loads = [r[1] for r in registry.QUERIES["op5_kd_sharding"](spark, "/root/testdata/sf0.01").groupBy("shard").sum("size").collect()]
    assert len(loads) == 8 and max(loads) < 1.05 * min(loads)
