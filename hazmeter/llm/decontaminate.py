"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage of a document by k edits, k a share of m. Cut into k + 1
pieces, one piece at least then stands in the passage unchanged. One Aho-Corasick automaton finds the pieces of
all items of a block in one pass over each whole text; each hit fixes where the item would lie. An edit touches at
most q of the item's q-grams, so a place that lacks more than k q of them is out; for the others Myers'
bit-parallel distance decides. Letters are compared in lower case and runs of other characters as one blank.

Items come to the executors in blocks of bounded size, one pass over the documents a block, whatever the size of
the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Edits allowed, as a share of the item's characters.
ERRORS = 0.08
#: Items below so many characters are found without any edit and between blanks: an edit more would be another phrase.
LEAST = 32
#: Characters of the items in one block.
BLOCK = 1_000_000
#: Length of the grams that a place must share before its distance is taken.
GRAM = 6

_GAP = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return _GAP.sub(" ", low)


def _origin(text: str) -> np.ndarray:
    """Place in ``text`` of each character of normalise(text)."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    keep = np.ones(len(low), dtype=bool)
    for m in _GAP.finditer(low):
        keep[m.start() + 1 : m.end()] = False
    return np.flatnonzero(keep)


def _grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def _peq(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of ``text``, and where the first best one ends.

    ``anchored``: to a prefix of ``text`` instead.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
        ph = (ph << 1 | anchored) & full
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple], errors: float = ERRORS, least: int = LEAST):
        import ahocorasick

        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for ident, text in items:
            p = normalise(text or "").strip()
            if not p:
                continue
            n, k = len(self.items), int(len(p) * errors)
            if len(p) < least:
                self.items.append((ident, p, 0, None, None, None))
                pieces.setdefault(p, []).append((n, 0))
                continue
            self.items.append((ident, p, k, _peq(p), _peq(p[::-1]), _grams(p)))
            cuts = [len(p) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(p[a:b], []).append((n, a))
        self.automaton = None
        if pieces:
            self.automaton = ahocorasick.Automaton()
            for piece, at in pieces.items():
                self.automaton.add_word(piece, (len(piece), at))
            self.automaton.make_automaton()

    def __call__(self, text: str | None, any_: bool = False) -> list[tuple]:
        """(item, distance, start, end) for each item found, the best place each; ``any_``: one will do."""
        if not text or not self.automaton:
            return []
        norm, out = normalise(text), []
        hits: dict[int, set[int]] = {}
        for end, (size, at) in self.automaton.iter(norm):
            for n, off in at:
                hits.setdefault(n, set()).add(end + 1 - size - off)  # where the item would begin
        origin = None
        for n, begins in hits.items():
            ident, p, k, peq, back, grams = self.items[n]
            if peq is None:
                at = min((x for x in begins if norm[x - 1 : x] in ("", " ") and norm[x + len(p) : x + len(p) + 1] in ("", " ")), default=-1)
                if at >= 0:
                    if origin is None:
                        origin = _origin(text)
                    out.append((ident, 0, int(origin[at]), int(origin[at + len(p) - 1]) + 1))
                    if any_:
                        return out
                continue
            best = None
            order = sorted(begins)
            i = 0
            while i < len(order):
                j = i
                while j + 1 < len(order) and order[j + 1] - order[j] <= k:
                    j += 1
                lo, hi = max(0, order[i] - k), order[j] + len(p) + k
                i = j + 1
                window = norm[lo:hi]
                at = window.find(p)
                if at >= 0:
                    d, stop = 0, at + len(p)
                elif len(grams - _grams(window)) > k * GRAM:
                    continue
                else:
                    d, stop = myers(peq, len(p), window)
                if d <= k and (best is None or d < best[0]):
                    best = d, lo, lo + stop
                    if d == 0 or any_:
                        break
            if best:
                d, lo, stop = best
                _, size = myers(back, len(p), norm[lo:stop][::-1], anchored=True)
                if origin is None:
                    origin = _origin(text)
                out.append((ident, d, int(origin[stop - size]), int(origin[stop - 1]) + 1))
                if any_:
                    return out
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, size: int = BLOCK) -> Iterator[list[tuple]]:
    """The items in blocks of about ``size`` characters; the driver holds one block at a time."""
    held, n = [], 0
    for ident, text in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        held.append((ident, text))
        n += len(text)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", errors: float = ERRORS, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, distance, start_at, end_at): one row for each row of ``docs`` and each item that it holds.

    The place is the first of the best, in code points of the whole text, the end exclusive. Null and empty texts hold
    nothing, null and empty items are in nothing; an item that two rows of ``items`` hold is reported for each. Without
    items or documents the result is empty. Repeated rows of ``docs`` are reported each. Texts of any length are read
    whole; columns beside id and text are ignored, whatever their names.
    """
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    shape = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance long, start_at long, end_at long"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for part in blocks(items, item_id, item_text, block):
        held = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, held=held):
            match = Matcher(held.value, errors, least)
            for b in batches:
                got = [(i, *x) for i, t in enumerate(b.column(1).to_pylist()) for x in match(t)]
                take = b.column(0).take(pa.array([g[0] for g in got], pa.int64()))
                cols = [[g[k] for g in got] for k in range(1, 5)]
                yield pa.RecordBatch.from_arrays([take, pa.array(cols[0]) if got else pa.array([], pa.int64()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["doc_id", "item_id", "distance", "start_at", "end_at"])

        out = rows.mapInArrow(run, shape)
        found = out if found is None else found.unionByName(out)
    return docs.sparkSession.createDataFrame([], shape) if found is None else found


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", errors: float = ERRORS, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that hold an item, all columns kept, whatever their names.

    Null and empty texts hold nothing and stay; repeated rows stay or go together. An empty table stays empty, and
    without items every row stays.
    """
    place = docs.columns.index(text_col)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    docs = docs.toDF(*inner)
    for part in blocks(items, item_id, item_text, block):
        held = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, held=held):
            match = Matcher(held.value, errors, least)
            for b in batches:
                yield b.filter(pa.array([not match(t, True) for t in b.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))
