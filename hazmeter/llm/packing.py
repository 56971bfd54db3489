"""Best-fit packing planned over the histogram of lengths.

Tokenised documents are pieces of 1 to ``size`` tokens. How many pieces there are of each length is all that the
plan needs: best-fit in decreasing order runs over counts, so its cost depends on the number of distinct lengths,
never on the number of documents. The plan says, for each length, where the pieces of each rank go; pieces take
their places by rank within length. Ranks come from counters kept per task and a running sum over tasks.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stage

SIZE = 4096
EOS = 1
#: Words after which a worker begins to forget those not seen again, and the longest that is remembered at all.
REMEMBERED, LONGEST = 250_000, 64
#: What shows whether a vocabulary's rules look across blanks or know more signs than expected.
PROBE = "Don't stop;\nIT'S 3,14 o'clock... caf\u00e9 Stra\u00dfe \u4f60\u597d (a+b)=c! x_y <|endoftext|> \U0001d518 e\u0301 \ufb01 ? I'LL we've"
#: Signs that end words.
TAIL = ".,;:!?"

assert sys.byteorder == "little" and array("I").itemsize == 4


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The vocabulary's rules never look across a blank or a line end: white space is dropped, normal forms do not
    join across a blank, and no token spans one. So each blank-separated chunk is encoded once by the tokenizer
    and remembered, which is exact and many times faster than encoding every text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.known, self.older = Tokenizer.from_file(path), {"": b""}, {}
        rules = json.loads(self.tok.to_str())
        steps = rules["pre_tokenizer"].get("pretokenizers", [])
        self.plain = None
        if steps and steps[-1]["type"] == "ByteLevel":
            # for one lower-case word of Latin letters, normal forms and splits change nothing
            rules |= {"normalizer": None, "pre_tokenizer": steps[-1], "added_tokens": []}
            self.plain = Tokenizer.from_str(json.dumps(rules))
        if self.encode(PROBE) != array("I", self.tok.encode(PROBE, add_special_tokens=False).ids).tobytes():
            raise ValueError(f"{path}: its rules look across blanks, so words cannot be learned one by one")

    def encode(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        new = set(chunks).difference(self.known)
        if new:
            self._learn(new, chunks)
        known = self.known
        out = b"".join([known[c] for c in chunks])
        for c in new:
            if len(c) > LONGEST:  # base64 and the like would fill the memory
                known.pop(c, None)
        return out

    def _learn(self, new: set[str], chunks: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known, self.older, new = {"": b""}, self.known, set(chunks)  # what is used again moves over
            new.discard("")
        known, older = self.known, self.older
        plain, words, made = {}, {}, []
        for c in new:
            if c in older:
                known[c] = older[c]
                continue
            # a word and the signs after it are split from each other, and case is folded, before anything else
            word = c.rstrip(TAIL)
            if word.isalpha() and max(word) < "\u0100":
                low = word.lower()
                if low not in known and low not in plain:
                    if low in older:
                        known[low] = older[low]
                    else:
                        plain[low] = None
                if low != c:
                    made.append((c, low, tail := c[len(word) :]))
                    if tail not in known:
                        words[tail] = None
            else:
                words[c] = None
        for tok, part in ((self.plain or self.tok, list(plain)), (self.tok, list(words))):
            if part:
                for c, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False)):
                    known[c] = array("I", e.ids).tobytes()
        for c, low, tail in made:
            known[c] = known[low] + known[tail]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process: a worker that Spark uses again still knows the words of its earlier tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth[, ids]): the pieces of every row's token ids.

    Null text counts as empty and gives the end token alone. Only documents over ``size`` are cut. ``nth`` counts
    the task's earlier pieces of this length.
    """

    def run(batches):
        enc, seen, task = encoder(path), np.zeros(size + 1, dtype=np.int64), TaskContext.get().partitionId()
        end = np.asarray([EOS], dtype="<u4").tobytes()

        def made(cols):
            out = [pa.array(cols[0], kinds[0]), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]], pa.array(np.full(len(cols[0]), task, dtype=np.int32)), pa.array(cols[5], pa.int64())]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, dtype="<i4") for x in cols[6]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(out, names=names)

        kinds = []
        for b in batches:
            kinds = [b.column(0).type]
            cols = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.encode(text or "") + end
                for k in range(0, len(ids), 4 * size):
                    part = ids[k : k + 4 * size]
                    n = len(part) // 4
                    for c, x in zip(cols, (doc, k // (4 * size), k // 4, n, zlib.crc32(part), int(seen[n]), part if with_ids else None)):
                        c.append(x)
                    seen[n] += 1
                if len(cols[0]) >= 2000:
                    yield made(cols)
                    cols = [[] for _ in range(7)]
            yield made(cols)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * with_ids
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, shape)


def plan(lengths: dict[int, int], size: int = SIZE) -> dict[str, np.ndarray]:
    """Best-fit decreasing over counts: runs of (length, first rank, first sequence, offset), sorted by length and rank.

    Pieces of one length with ranks from a run's first on, until the next run's, go one each to the sequences from
    the run's first on. Sequences that are filled alike are handled as one group, so at most ``size`` groups by room
    are open at a time.
    """
    open_: dict[int, list[list[int]]] = {}  # room left: [first sequence, how many]
    rooms: list[int] = []  # sorted rooms in use
    runs: list[tuple[int, int, int, int]] = []
    fresh = 0

    def put(room: int, first: int, n: int) -> None:
        if room not in open_:
            open_[room] = []
            rooms.insert(int(np.searchsorted(rooms, room)), room)
        open_[room].append([first, n])

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            at = int(np.searchsorted(rooms, length))
            if at < len(rooms):
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    del rooms[at]
            else:
                # new sequences hold as many of this length each as fit: open what that takes
                room, first, n = size, fresh, -(-left // (size // length))
                fresh += n
            use = min(left, n)
            runs.append((length, rank, first, size - room))
            if use < n:
                put(room, first + use, n - use)
            if room > length:
                put(room - length, first, use)
            left, rank = left - use, rank + use
    runs.sort()
    cols = np.array(runs, dtype=np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), cols))


def place(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to a staged table of :func:`pieces`."""
    spark = cut.sparkSession
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    runs = plan(counts, size)
    held = spark.sparkContext.broadcast((runs["length"], runs["rank"], runs["sequence"], runs["offset"]))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = stage(by_task.select(F.col("length").alias("l"), F.col("task").alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranks")
    # one row a length and task: it grows with the input, so it is never broadcast
    ranked = cut.join(base.hint("merge"), (F.col("length") == F.col("l")) & (F.col("task") == F.col("t"))).withColumn("rank", F.col("nth") + F.col("base")).drop("l", "t", "base", "nth", "task")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")

    def seat(batches):
        lengths, ranks, sequences, offsets = held.value
        low = np.searchsorted(lengths, np.arange(size + 2))  # where each length's runs begin
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns))
            n, r = cols["length"].to_numpy(), cols.pop("rank").to_numpy()
            key = n * (1 << 42) + r
            at = np.searchsorted(lengths * (1 << 42) + ranks, key, "right") - 1
            assert (at >= low[n]).all()
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(sequences[at] + r - ranks[at]), pa.array(offsets[at])], names=[*cols, "sequence_id", "offset"])

    return ranked.mapInArrow(seat, f"{shape}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the token ids if asked for.

    Every row is packed, null and empty texts as their end token; repeated rows are packed each. An empty table
    gives an empty result. Other columns are ignored.
    """
    return place(stage(pieces(docs, path or vocabulary(), size, id_col, text_col, with_ids), "pieces"), size)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
