"""The parts of the near stage: fingerprint links, cells that hold every pair, and bitmaps of several widths."""

import numpy as np
import pyarrow as pa

from hazmeter.llm import near_copies, simhash

from .conftest import table


def test_fingerprints_link(spark, monkeypatch):
    base = [f"w{k * 7919 % 3001}" for k in range(300)]
    texts = [" ".join(base), " ".join([*base, "tail"]), " ".join(["Head", *base]), " ".join(base).upper(), "another text of its own kind"]
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *a, **k: asked.append(a) or links(fps, *a, **k))
    got = {r.doc_id: r.comp for r in near_copies.near_groups(table(spark, enumerate(texts))).collect()}
    assert asked == [(near_copies.RADIUS, near_copies.CELL)]
    assert got[0] == got[1] == got[2] == got[3] != got[4]


def test_nearest_links():
    rng = np.random.default_rng(8)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 63, 30).astype(np.uint64)[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (1, 12)).astype(np.uint64)), rng.integers(0, 1 << 63, (30, 12)).astype(np.uint64)]).ravel())
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    i, j = simhash._nearest(np.zeros(len(fps), dtype=np.int64), fps, 7)
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert (apart[i, j] <= 7).all()
    for y in range(len(fps)):
        before = apart[:y, y][apart[:y, y] <= 7]
        assert sorted(apart[i[j == y], y])[:1] == sorted(before)[:1]


def test_cells_hold_every_pair():
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), *rng.integers(60, 3000, 200).tolist()]:
        both = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        apart = len(both) // 4  # the most that a similarity of 0.8 allows
        for mine in (0, apart // 2, apart):
            other = rng.integers(0, 1 << 63, apart).astype(np.uint64)
            a, b = np.unique(np.r_[both, other[:mine]]), np.unique(np.r_[both, other[mine:]])
            assert 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
            assert len(np.intersect1d(near_copies.cells(a), near_copies.cells(b)))


def test_bitmaps_of_two_widths():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (300, 360, 5, 9000, 700, 800)]
    maps = [near_copies.bitmap(s, near_copies._width(len(s))) for s in sets]
    bits = near_copies._Bits(pa.array(maps, pa.list_(pa.int64())))
    assert len(set(bits.width.tolist())) > 2
    for k, s in enumerate(sets):
        w = 4
        while w <= bits.width[k]:
            assert (bits.of(np.array([k]), w)[0] == near_copies.bitmap(s, w).view(np.uint64)).all()
            w *= 2
