"""Substring deduplication over sliding sentence spans.

A sentence ends with a word that ends in a full stop, question or exclamation mark, or before a line break, once it
has ``SHORT`` words; shorter ones (initials, list numbers, cries) go on with what follows. Every run of ``RUN``
consecutive sentences is hashed and all runs of all documents are sorted together; every run that is not the first
of its text is a repeat, and the sentences that it covers go. A longer repeated run consists of runs of ``RUN``
sentences that are repeats themselves, so hashing these removes just what hashing the runs of every greater length
would, with as many rows as there are sentences.

A passage may be quoted from the middle of a sentence, and a sentence without an end mark may be as long as its
text. So stretches of ``STRETCH`` words are hashed as well, begun where the hash of three words is the least of
``WINDOW`` consecutive ones. Such a choice depends on nearby words alone: any ``WINDOW + STRETCH - 1`` = 50 words that
two documents share hold a stretch of both. A repeated stretch goes word for word.

Words are what ASCII blanks separate, compared with A-Z in lower case; a run's text is its words joined by single
blanks. A digest of 128 bits stands for it, which among 10^13 runs lets two different texts agree with a chance of
about 10^-13. First is the smallest document id, then the place in the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_staged, name_runs, stage
from .words import BLANK, FOLD, MIX, hashes, mixed, pieces, words

#: Sentences of a run: "several". With two, chance meetings and page furniture of two short sentences would go too.
RUN = 3
#: Words of a sentence at least.
SHORT = 4
#: Words of a stretch, and places of which one begins a stretch.
STRETCH, WINDOW = 24, 27
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".!?")] = True
_CLOSE = np.zeros(256, dtype=bool)
_CLOSE[list(b"\"')]}")] = True
_TOP = np.uint64(2**64 - 1)


def _cuts(a: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Index of the last word of each sentence."""
    n = len(start)
    if not n:
        return np.zeros(0, dtype=np.int64)
    tail = a[end - 1]
    mark = _MARK[tail] | _CLOSE[tail] & (end - start > 1) & _MARK[a[np.maximum(end - 2, 0)]]
    lines = np.cumsum(a == 10)
    mark[:-1] |= lines[start[1:]] > lines[end[:-1] - 1]
    last = np.r_[doc[1:] != doc[:-1], True]
    out, begin = [], 0
    for k, final in zip(np.flatnonzero(mark | last).tolist(), last[mark | last].tolist()):
        if final or k - begin >= SHORT - 1:
            out.append(k)
            begin = k + 1
    return np.array(out, dtype=np.int64)


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        v = np.minimum(v[:-step], v[step:])
        have += step
    return v


def _stretches(a: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Index of the first word of each stretch."""
    n = len(start)
    if n < STRETCH:
        return np.zeros(0, dtype=np.int64)
    h = hashes(a, start, end)
    three = mixed(mixed(h[:-2] * MIX + h[1:-1]) * MIX + h[2:])
    # each document's values stand apart from the others' by places that are never the least
    inside = np.flatnonzero(doc[2:] == doc[:-2])
    first = np.searchsorted(doc, np.arange(int(doc[-1]) + 2))
    at = inside - first[doc[inside]] + (first + np.arange(len(first)) * WINDOW)[doc[inside]] + WINDOW
    v = np.full(int(at[-1]) + WINDOW + 1 if len(at) else 0, _TOP)
    if not len(at):
        return np.zeros(0, dtype=np.int64)
    v[at] = three[inside] >> np.uint64(1)
    least = _least(v, WINDOW)
    reach = ~_least(~least, WINDOW)  # the greatest of the windows that hold a place
    picked = inside[reach[at - WINDOW + 1] == v[at]]
    picked = picked[picked + STRETCH <= n]
    return picked[doc[picked + STRETCH - 1] == doc[picked]]


def spans(a: np.ndarray, edges: np.ndarray, run: int = RUN) -> tuple[np.ndarray, ...]:
    """(document, digest high, digest low, start, end) of each run and stretch; places are bytes of ``a``."""
    start, end, doc = words(a, edges)
    last = _cuts(a, start, end, doc)
    head = np.r_[0, last[:-1] + 1] if len(last) else last
    k = len(last) - run + 1
    same = np.flatnonzero(doc[head[:k]] == doc[last[run - 1 :]]) if k > 0 else np.zeros(0, dtype=np.int64)
    long = _stretches(a, start, end, doc)
    first, final = np.r_[head[same], long], np.r_[last[same + run - 1] if k > 0 else same, long + STRETCH - 1]
    first, final = np.divmod(np.unique(first * (len(start) + 1) + final), len(start) + 1)  # a run may be a stretch
    # the words in lower case, joined by single blanks
    blank = BLANK[a]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    norm = FOLD[a]
    norm[blank] = 32
    place = np.r_[0, np.cumsum(keep)]
    view = memoryview(norm[keep].tobytes())
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(view[x:y]) for x, y in zip(place[start[first]].tolist(), place[end[final]].tolist())])
    both = np.frombuffer(raw, dtype=">i8").reshape(-1, 2).astype(np.int64)
    return doc[first], both[:, 0], both[:, 1], start[first], end[final]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """(doc_id, th, spans): for each document with repeats, the byte ranges (start, end) to take out, unmerged.

    Rows that repeat both id and text count once; ``th`` tells texts of one id apart and is null where ids are unique.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    twice = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    if twice:
        rows = rows.dropDuplicates()
    rows = rows.select("doc_id", (F.sha2("text", 256) if twice else F.lit(None).cast("string")).alias("th"), "text")

    def cut(batches):
        for b in batches:
            for at, _, data, edges in pieces(b.column(2)):
                doc, high, low, x, y = spans(data, edges, run)
                own, begin = pa.array(doc + at), edges[doc]
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(high), pa.array(low), pa.array((x - begin).astype(np.int32)), pa.array((y - begin).astype(np.int32))], names=["doc_id", "th", "h", "g", "x", "y"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = stage(rows.mapInArrow(cut, f"doc_id {kind}, th string, h long, g long, x int, y int"), "spans")
    order = ["doc_id", "th", "x", "y"] if twice else ["doc_id", "x", "y"]
    again = name_runs(found, "h", ["h", "g"], order, "repeats", repeats_only=True).where("not is_first")
    out = stage(again.groupBy("doc_id", "th").agg(F.collect_list(F.struct("x", "y")).alias("spans")), "repeated")
    drop_staged(found)
    return out


def _merged(spans_: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for x, y in sorted((s["x"], s["y"]) for s in spans_):
        if out and x <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_removed, removed (array of start, end), clean_text.

    ``n_removed`` counts the code points taken out, ``removed`` are their places in the whole text, the end exclusive.
    Null and empty texts have no sentence and give an empty text. Rows that repeat id and text are one document and
    come out alike; of equal texts with several ids the one with the smallest stays whole. A null id is the first of
    all. An empty table gives an empty result; columns beside id and text are ignored, whatever their names.
    """
    out = repeated_spans(docs, id_col, text_col, run).toDF("other", "th", "spans")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("other")) & (F.col("th").isNull() | (F.sha2("text", 256) == F.col("th")))
    joined = rows.join(out, same, "left").select("doc_id", "text", "spans")

    def cut(batches):
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            counts, places, texts = [], [], []
            for text, gone in zip(b.column(1), b.column(2).to_pylist()):
                if not gone:
                    counts.append(0)
                    places.append([])
                    texts.append(text.as_py())
                    continue
                raw, at, chars, n, kept, here = text.as_buffer().to_pybytes(), 0, 0, 0, [], []
                for x, y in _merged(gone):
                    kept.append(raw[at:x])
                    chars += len(raw[at:x].decode())
                    size = len(raw[x:y].decode())
                    here.append({"start": chars, "end": chars + size})
                    n, chars, at = n + size, chars + size, y
                    if not kept[-1] or kept[-1][-1:].isspace():  # one of the two gaps goes too
                        bare = len(raw) - len(raw[at:].lstrip(b" \t\n\v\f\r")) if raw[at : at + 1].isspace() else at
                        chars, at = chars + bare - at, bare
                kept.append(raw[at:])
                counts.append(n)
                places.append(here)
                texts.append(b"".join(kept).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(places, pair), pa.array(texts, pa.string())], names=["doc_id", "n_removed", "removed", "clean_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_removed long, removed array<struct<start:bigint,end:bigint>>, clean_text string")


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    joined = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", "n_removed", joined.alias("removed"), F.length("clean_text").cast("long").alias("clean_chars"), F.sha2("clean_text", 256).alias("clean_sha256"))
