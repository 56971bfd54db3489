"""Near copies against all pairs of sets of word tuples."""

import collections
import random

import numpy as np

from hazmeter.llm import near_copies

from .conftest import table


def word_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups_of(texts):
    """The smallest index that each text reaches over pairs with a similarity of 0.8 or more."""
    sets, root = [word_shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(x) for x in range(len(root))]


def copies():
    rng = random.Random(11)
    line = " ".join(f"common{i}" for i in range(12))
    texts = [None, "", "one two", "One  two"]
    for n in (40, 90, 150, 400):
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        for edits in (1, 2, 3, 4, 6, 9) * (12 if n == 150 else 1):
            copy = list(base)
            for at in rng.sample(range(n), edits):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [line + " " + " ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(30)]
    # a chain, each like the next only, and texts made of common shingles alone
    chain = [f"c{k}" for k in range(120)]
    for k in range(12):
        texts.append(" ".join(chain))
        chain[k * 9] = f"y{k}"
        chain[k * 9 + 1] = f"z{k}"
    texts += [line + " " + line + f" tail{k % 3}" for k in range(9)]
    return texts


def test_groups(spark):
    texts = copies()
    root = groups_of(texts)
    assert len(set(root)) > 35 and max(collections.Counter(root).values()) > 30
    for hot in (near_copies.HOT, 20, 5):
        old, near_copies.HOT = near_copies.HOT, hot
        try:
            got = {r.doc_id: r.comp for r in near_copies.near_groups(table(spark, enumerate(texts)), hot=hot).collect()}
        finally:
            near_copies.HOT = old
        assert all((got[i] == got[j]) == (root[i] == root[j]) for i in range(len(texts)) for j in range(i))
    kept = near_copies.drop_near_copies(table(spark, enumerate(texts))).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root))


def test_shared_cells():
    rng = random.Random(4)
    for _ in range(200):
        rows = sorted((rng.randrange(12), rng.randrange(6)) for _ in range(rng.randrange(40)))
        members = collections.defaultdict(set)
        for c, m in rows:
            members[c].add(m)
        import pyarrow as pa

        cuts = sorted(rng.choices(range(len(rows) + 1), k=4))
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a:b]], pa.int64()) for k in (0, 1)], names=["cell", "node"]) for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        got = [x for b in near_copies._shared(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(got) == sorted((c, m) for c, v in members.items() if len(v) > 1 for m in v)


def test_rows_of_one_id(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(3, base), (7, "an unrelated text of its own kind"), (7, base + " z"), (9, "alone here"), (9, "alone here"), (None, base), (None, "nobody knows whose this is")]
    kept = near_copies.drop_near_copies(table(spark, rows))
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter({(3, base): 1, rows[1]: 1, rows[3]: 1, rows[6]: 1})
    assert kept.columns == table(spark, rows).columns


def test_odd_tables(spark, odd, empty):
    rows, df = odd
    root = groups_of([t for _, t in rows])
    kept = near_copies.drop_near_copies(df)
    assert kept.count() == len(set(root)) and kept.columns == df.columns
    assert near_copies.drop_near_copies(empty).count() == 0


def test_bitmap_bound():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        apart = np.bitwise_count((near_copies.bitmap(a) ^ near_copies.bitmap(b)).view(np.uint64)).sum()
        assert apart <= len(np.setxor1d(a, b))
