"""Near copies: SimHash links, then an exact similarity join for what they leave; one document of each group stays.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Each set gets
its SimHash fingerprint, and the Gray-order index of ``simhash`` links every fingerprint to the nearest one within
``RADIUS`` bits in each of its cells. Links are verified on whole sets and grouped.

Fingerprints of near copies may differ in more bits than any index can search, so an exact join looks for the pairs that
are left between different groups. Each set is dealt by hash into parts, more than its near copies may have differing
shingles, so that some parts are equal; of these every pair has one among the fullest parts of both (``cells``).
Within a cell of several groups pairs are dropped by size and by parity bitmaps, whose differing bits never exceed the
differing shingles, and what stays is verified. No pair is lost: both bounds are exact.

Cells with many members send, for each member that is not in the main group, the pair with the nearest member of another
group, round by round until no group grows, and then every pair whose members are still in different groups; so a large
group of copies costs no rows for all its pairs. Cells over ``HOT`` members are never held by one task: their stars come
from joins, and what is left of them is dealt out in blocks of pairs.

Shingles and texts are named by hashes of 64 bits; two texts of one hash would count as one.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, drop_staged, scratch, stage
from .words import MIX, hashes, mixed, pieces, words

SHINGLE = 5
#: Near copies share at least ``LIKE[0] / LIKE[1]`` of their joint shingles.
LIKE = (4, 5)
#: Bits of SimHash fingerprints that the index searches, and members of its cells that are not cut further.
RADIUS, CELL = 7, 4_096
#: Cells with more members send the nearest pairs before all others; cells over HOT members are dealt out.
SMALL, HOT = 12, 8_192
#: Words of 64 bits in a bitmap: about as many bits as the set has shingles, within these bounds.
BITS, MOST_BITS = 4, 64
#: Bits of the filter that tells which texts to read once more: two megabytes, whatever the input.
FILTER = 1 << 24


def shingles(a: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text of fewer words is one shingle."""
    start, end, doc = words(a, edges)
    h = hashes(a, start, end)
    first = np.searchsorted(doc, np.arange(len(edges)))
    n = len(h) - SHINGLE + 1
    if n > 0:
        s = h[:n]
        for i in range(1, SHINGLE):
            s = mixed(s * MIX + h[i : i + n])
    out = []
    for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
        if y - x >= SHINGLE:
            out.append(np.unique(s[x : y - SHINGLE + 1]))
        else:
            one = np.full(1, y - x, dtype=np.uint64)
            for k in range(x, y):
                one = mixed(one * MIX + h[k])
            out.append(one)
    return out


def of_text(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return shingles(raw, np.array([0, len(raw)]))[0]


def _partner(n: int) -> int:
    """The most shingles that a near copy of ``n`` shingles has."""
    return n * LIKE[1] // LIKE[0]


def _differ(n: int, m: int) -> int:
    """The most shingles in which near copies of ``n`` and ``m`` shingles differ."""
    return (n + m) * (LIKE[1] - LIKE[0]) // sum(LIKE)


def _buckets() -> tuple[list[int], list[int]]:
    """Where each bucket of sizes begins, and its number of parts; near copies lie in one bucket or in two neighbours."""
    edges, parts = [1], []
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, _partner(edges[-1] - 1) + 1))
        most = _differ(edges[-1] - 1, _partner(edges[-1] - 1))
        parts.append(most + 1 + (most + 4) // 5)
    return edges, parts


EDGES, PARTS = _buckets()


def cells(s: np.ndarray) -> np.ndarray:
    """Names of the fullest parts of a sorted set: every near copy has one of them among its own."""
    n, own = len(s), bisect.bisect_right(EDGES, len(s)) - 1
    asked = [(own, _differ(n, _partner(n)))]
    if own and _partner(EDGES[own] - 1) >= n:  # a near copy may lie in the bucket below
        asked.append((own - 1, _differ(n, EDGES[own] - 1)))
    total, out = np.r_[np.uint64(0), np.cumsum(mixed(s))], []
    for bucket, most in asked:
        parts = PARTS[bucket]
        ends = np.searchsorted(s >> np.uint64(32), (np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(parts - 1)) // np.uint64(parts))
        starts = np.r_[0, ends[:-1]]
        first = np.argsort(starts - ends, kind="stable")[: most + 1]
        part = first.astype(np.uint64) + np.uint64(bucket << 40)
        out.append(mixed(mixed(total[ends[first]] - total[starts[first]] + part * MIX) + (ends - starts)[first].astype(np.uint64)))
    return np.concatenate(out)


def bitmap(s: np.ndarray, size: int = BITS) -> np.ndarray:
    odd = np.bincount((s & np.uint64(64 * size - 1)).astype(np.int64), minlength=64 * size).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def _width(n: int) -> int:
    """Words of the bitmap of ``n`` shingles, a power of two; a bitmap's halves added bit by bit are the next smaller one."""
    return min(MOST_BITS, max(BITS, 1 << max(0, (n * 3 // 256)).bit_length()))


class _Bits:
    """Bitmaps of several widths, one for each row."""

    def __init__(self, column: pa.Array) -> None:
        self.flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        self.width = np.diff(column.offsets.to_numpy()).astype(np.int64)
        self.at = np.r_[0, np.cumsum(self.width)[:-1]]

    def of(self, rows: np.ndarray, words: int) -> np.ndarray:
        at, out = self.at[rows], np.zeros((len(rows), words), dtype=np.uint64)
        for k in range(int(self.width[rows].max(initial=words)) // words):
            on = self.width[rows] > k * words
            out[on] ^= self.flat[at[on][:, None] + (k * words + np.arange(words))]
        return out


def _apart(n: np.ndarray, bits: _Bits, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing bits of the pairs (i, j) that may be near copies, by size and by bitmap; -1 for the others.

    Both bounds are exact: no near copy is refused.
    """
    out = np.full(len(i), -1, dtype=np.int64)
    on = np.flatnonzero((n[j] * LIKE[1] >= n[i] * LIKE[0]) & (n[i] * LIKE[1] >= n[j] * LIKE[0]))
    words = np.minimum(bits.width[i[on]], bits.width[j[on]])
    for w in np.unique(words).tolist():
        for part in np.array_split(on[words == w], 1 + len(on) * w // (1 << 20)):
            apart = np.bitwise_count(bits.of(i[part], w) ^ bits.of(j[part], w)).sum(axis=1, dtype=np.int64)
            out[part] = np.where(apart * sum(LIKE) <= (n[i[part]] + n[j[part]]) * (LIKE[1] - LIKE[0]), apart, -1)
    return out


def _shared(batches):
    """(cell, node) of the cells with two different members; rows come sorted by both."""
    last, sent = None, False  # the last row, and whether it has been given out
    for b in batches:
        c, m = (x.to_numpy(zero_copy_only=False) for x in b.columns)
        if not len(c):
            continue
        before_c, before_m = np.r_[c[0] if last is None else last[0], c[:-1]], np.r_[~m[0] if last is None else last[1], m[:-1]]
        fresh = (c != before_c) | (m != before_m)
        fresh[0] |= last is None
        c, m = c[fresh], m[fresh]
        if not len(c):
            continue
        if last is not None and not sent:
            c, m = np.r_[last[0], c], np.r_[last[1], m]
        held = last is not None and sent and c[0] == last[0]  # its cell is known to be shared
        many = np.r_[held, c[1:] == c[:-1]]
        many |= np.r_[many[1:] & (c[1:] == c[:-1]), False]
        if held:
            many[c == c[0]] = True
        last, sent = (c[-1], m[-1]), bool(many[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c[many]), pa.array(m[many])], names=["cell", "node"])


def _cells(batches):
    """Tables of whole cells, some ten thousand rows at once. Rows come sorted by cell."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= 32_768:
            rows = pa.Table.from_batches(held).combine_chunks()
            c = rows["cell"].to_numpy()
            cut = int(np.searchsorted(c, c[-1], "left"))
            if cut:
                yield rows.slice(0, cut)
            rest = rows.slice(cut)
            held, size = rest.to_batches(), rest.num_rows
    if size:
        yield pa.Table.from_batches(held)


def _across(batches, nearest: bool):
    """Pairs (u, v) of each cell whose members are in different groups, and the members (cell not null) of the cells
    that hold pairs back; ``nearest``: in large cells one pair for each member, with the least differing bits, which
    ties groups together in a few rounds where all pairs would grow with the square of a group."""
    for rows in _cells(batches):
        rows = rows.take(pa.array(np.lexsort((rows["node"].to_numpy(), rows["cell"].to_numpy())))).combine_chunks()
        cell, node, n, group = (rows[c].to_numpy() for c in ("cell", "node", "n", "comp"))
        bits = _Bits(pa.concat_arrays(rows["bits"].chunks))
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        end = np.r_[start[1:], len(cell)]
        several = np.minimum.reduceat(group, start) < np.maximum.reduceat(group, start)
        # small cells: every pair
        few = several & (end - start <= SMALL)
        i = np.concatenate([np.arange(x, y) for x, y in zip(start[few], end[few])] or [np.zeros(0, dtype=np.int64)])
        k = np.repeat(end[few], (end - start)[few]) - i - 1
        i, j = np.repeat(i, k), np.repeat(i + 1, k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        other = group[i] != group[j]
        i, j = i[other], j[other]
        like = _apart(n, bits, i, j) >= 0
        found, back = [(i[like], j[like])], []
        for x, y in zip(start[several & ~few].tolist(), end[several & ~few].tolist()):
            names, counts = np.unique(group[x:y], return_counts=True)
            every, main, spokes = np.arange(x, y), names[counts.argmax()], False
            for i in every[group[x:y] != main].tolist():
                js = every[(group[x:y] != group[i]) & (nearest | (group[x:y] == main) | (every > i))]
                apart = _apart(n, bits, np.full(len(js), i), js)
                hit = js[apart >= 0]
                if nearest and len(hit):
                    hit = hit[[apart[apart >= 0].argmin()]]
                if len(hit):
                    found.append((np.full(len(hit), i), hit))
                    spokes = True
            if spokes and nearest:
                back.append(every)
        i, j = (node[np.concatenate(x)] for x in zip(*found))
        pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)
        kept = np.concatenate(back) if back else np.zeros(0, dtype=np.int64)
        none, null = np.zeros(len(kept), np.int64), np.r_[np.ones(pairs.shape[1], bool), np.zeros(len(kept), bool)]
        data = [np.r_[pairs[0], none], np.r_[pairs[1], none], *[np.r_[np.zeros(pairs.shape[1], np.int64), x[kept]] for x in (cell, node)]]
        yield pa.RecordBatch.from_arrays([pa.array(d, mask=null if c == "cell" else None) for c, d in zip(["u", "v", "cell", "node"], data)], names=["u", "v", "cell", "node"])


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell")


def _hot_stars(members: DataFrame) -> DataFrame:
    """Pairs of the first member of each cell, by a hash of little range so that cells of one group agree, and the others."""
    rank = F.xxhash64(F.lit("star"), F.pmod(F.col("cell"), F.lit(4)), "node")
    first = members.groupBy("cell").agg(F.min(F.struct(rank.alias("r"), F.col("node").alias("xnode"), F.col("n").alias("xn"))).alias("f")).select(F.col("cell").alias("of"), "f.*")
    near = F.least("n", "xn") * LIKE[1] >= F.greatest("n", "xn") * LIKE[0]
    return members.join(first, F.col("cell") == F.col("of")).where(near & (F.col("node") != F.col("xnode"))).select(F.least("node", "xnode").alias("u"), F.greatest("node", "xnode").alias("v"))


def _hot_blocks(rows: DataFrame) -> DataFrame:
    """Cells of several groups in blocks: each member once for each block of its cell, every two meet in one of them."""
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    sizes = sizes.select(F.col("cell").alias("of"), F.ceil(F.col("size") * 2 / HOT).cast("int").alias("k"))
    block = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    pair = rows.join(sizes, F.col("cell") == F.col("of")).withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return pair.select(F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "node", "n", "bits", "comp")


def _whole_sets(texts: DataFrame, asked: DataFrame, twice: bool) -> DataFrame:
    """(node, s): the whole sets of the asked nodes, from their texts; others go by a filter before they are cut."""
    marks = asked.select(F.expr(f"shiftright(node & {FILTER - 1}L, 6)").alias("w"), F.expr("shiftleft(1L, int(node & 63L))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bitset = np.zeros(FILTER // 64, dtype=np.uint64)
    bitset[marks["w"].to_numpy()] = marks["m"].to_numpy().view(np.uint64)
    held = asked.sparkSession.sparkContext.broadcast(bitset)

    def whole(batches):
        marked = held.value
        for b in batches:
            bit = b.column(0).to_numpy() & (FILTER - 1)
            b = b.filter(pa.array(marked[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1) == 1))
            for at, to, a, edges in pieces(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array([s.view(np.int64) for s in shingles(a, edges)], pa.list_(pa.int64()))], names=["node", "s"])

    sets = texts.select("node", "text").mapInArrow(whole, "node long, s array<bigint>").join(asked, "node", "left_semi")
    return stage(sets.dropDuplicates(["node"]) if twice else sets, "near-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are near copies: their texts' whole sets meet."""
    both = F.size(F.array_intersect("a", "b"))
    met = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    return stage(met.where(both * sum(LIKE) >= (F.size("a") + F.size("b")) * LIKE[0]).select("u", "v"), "near-links")


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): pairs of nodes whose fingerprints the index links or that share one, not yet verified."""
    first = stage(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-fps")
    linked = stage(simhash.links(first.select("fp"), radius, CELL, nearest=True), "near-linked")
    name = lambda c: first.toDF(c, "n" + c)
    pairs = linked.join(name("u"), "u").join(name("v"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    same = nodes.select("node", "fp").join(first, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    return stage(pairs.union(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-asked")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, node, comp): one row per row of ``docs``; node is the text's hash, rows of one comp are one group.

    Null counts as empty. Empty texts are alike, as are texts of the same few words.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))

    def describe(batches):
        for b in batches:
            for at, to, a, edges in pieces(b.column(2)):
                sets = shingles(a, edges)
                fps = np.array([simhash.majority(s) for s in sets], dtype=np.uint64).view(np.int64)
                bits = pa.array([bitmap(s, _width(len(s))) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[c.slice(at, to - at) for c in b.columns[:2]], pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), bits], names=["doc_id", "node", "n", "fp", "bits"])

    def parts(batches):
        for b in batches:
            for at, to, a, edges in pieces(b.column(1)):
                found = [cells(s) for s in shingles(a, edges)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy()[at:to], [len(x) for x in found]))], names=["cell", "node"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = stage(texts.select("doc_id", "node", "text").mapInArrow(describe, f"doc_id {kind}, node long, n long, fp long, bits array<bigint>"), "near-rows")
    nodes, twice = rows.drop("doc_id"), not rows.groupBy("node").count().where("count > 1").isEmpty()
    if twice:
        nodes = stage(nodes.dropDuplicates(["node"]), "near-nodes")

    # links by fingerprints
    pairs = fingerprint_links(nodes)
    sets = _whole_sets(texts, stage(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "near-asked"), twice)
    group = stage(components(_verified(pairs, sets), "near").toDF("g", "comp"), "near-group")
    drop_staged(sets)

    # what is left between groups
    dealt = texts.select("node", "text").mapInArrow(parts, "cell long, node long")
    members = stage((dealt.distinct() if twice else dealt).repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_shared, "cell long, node long"), "near-cells")
    large = stage(members.groupBy("cell").count().where(F.col("count") > hot).select("cell"), "near-hot")
    some = not large.isEmpty()
    back = members.join(large, "cell", "left_anti") if some else members
    heavy = stage(members.join(large, "cell"), "near-heavy") if some else None

    def grouped(m: DataFrame) -> DataFrame:
        named = m.join(nodes.select("node", "n", "bits"), "node").join(group, F.col("node") == F.col("g"), "left")
        return named.select("cell", "node", "n", "bits", F.coalesce("comp", "node").alias("comp"))

    nearest, sets = True, None
    while True:
        met = grouped(back)
        if some and sets is not None:
            met = met.union(_hot_blocks(stage(grouped(heavy), "near-heavy")))
        sent = stage(_by_cell(met).mapInArrow(lambda it, n=nearest: _across(it, n), "u long, v long, cell long, node long"), "near-pairs")
        pairs = sent.where("cell is null").select("u", "v")
        if sets is None:
            back = sent.where("cell is not null").select("cell", "node")
            if some:
                pairs = pairs.union(_hot_stars(heavy.join(nodes.select("node", "n"), "node")))
            pairs = stage(pairs.distinct(), "near-asked")
            asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(back.select("node"))
            sets = _whole_sets(texts, stage((asked.union(heavy.select("node")) if some else asked).distinct(), "near-asked"), twice)
        elif not some:  # blocks have cells of their own, so that hot cells are kept as they were
            back = sent.where("cell is not null").select("cell", "node")
        more = _verified(pairs.distinct(), sets)
        grown = not more.isEmpty()
        if grown:
            group = _merged(group, more)
        if not nearest or not some and back.isEmpty():
            break
        nearest = grown  # the last round looks at every pair that is left
    return rows.select("doc_id", "node").join(group, F.col("node") == F.col("g"), "left").select("doc_id", "node", F.coalesce("comp", "node").alias("comp"))


def _merged(group: DataFrame, more: DataFrame) -> DataFrame:
    """The groups (g, comp) of all nodes with a link, after more links."""
    ends = more.select(F.col("u").alias("g")).union(more.select("v")).distinct()
    group = stage(group.unionByName(ends.join(group, "g", "left_anti").select("g", F.col("g").alias("comp"))), "near-group")
    name = lambda c: group.select(F.col("g").alias(c), F.col("comp").alias("c" + c))
    joint = more.join(name("u"), "u").join(name("v"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    joint = components(joint, "near").toDF("old", "new")
    return stage(group.join(joint, F.col("comp") == F.col("old"), "left").select("g", F.coalesce("new", "comp").alias("comp")), "near-group")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, all columns kept whatever their names.

    The row with the smallest id stays, a null id only if the group has no other; of several texts of that id in one
    group the one with the smallest hash, of rows that repeat id and text any one. Rows are matched by id and text, so
    another document of the same id is its own. Null and empty texts are one group. An empty table stays empty.
    """
    with scratch(docs.sparkSession) as keep:
        groups = stage(near_groups(docs, id_col, text_col), "near-groups")
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("node").alias("node"))).alias("b")
        stay = keep(groups.groupBy("comp").agg(best).select(F.col("b.doc_id").alias("stay_id"), F.col("b.node").alias("stay_node")), "near-stay")
        again = not groups.groupBy("doc_id", "node").count().where("count > 1").isEmpty()
    names, inner = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    of = lambda c: F.col(inner[names.index(c)])
    rows = docs.toDF(*inner)
    kept = rows.join(stay, of(id_col).eqNullSafe(F.col("stay_id")) & (F.xxhash64(F.coalesce(of(text_col).cast("string"), F.lit(""))) == F.col("stay_node")), "left_semi")
    if again:
        kept = kept.withColumn("node", F.xxhash64(F.coalesce(of(text_col).cast("string"), F.lit("")))).dropDuplicates([inner[names.index(id_col)], "node"]).drop("node")
    return kept.toDF(*names)
