"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities, languages by buckets, small and of fixed size, so it is broadcast.
Counting and scoring are vectorised in numpy: the code points of a batch of texts form one array, n-gram hashes
come from shifted sums, and a document's score is the sum of matrix columns over its n-grams. Each text is read
whole; the codes of long ones are worked on in pieces that count each n-gram once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
#: At most about so many labelled rows are learned from, chosen by a hash of id and text.
FIT_ROWS = 40_000
UNKNOWN = "und"
#: Most languages that are learned; the matrix of counts that the driver gets has so many rows at most.
LANGUAGES = 1_000
#: Code points handled at once.
PIECE = 1 << 18
#: Rows of a batch that are worked on at once.
ROWS = 512
_MIX = np.uint32(2654435761)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    prior: np.ndarray
    orders: tuple[int, ...] = ORDERS

    @property
    def buckets(self) -> int:
        return len(self.logp)


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; everything that is no letter is a blank, runs of blanks are one."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = (a >= 97) & (a <= 122) | (a >= 0xAA) & (a != 0xD7) & (a != 0xF7)
    a = np.where(letter, a, np.uint32(32))
    keep = np.r_[True, letter[1:] | letter[:-1]]
    return a[keep]


def _buckets(a: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each place of ``a``."""
    h = np.full(len(a) - n + 1, n, dtype=np.uint32)
    for i in range(n):
        h = (h ^ a[i : len(a) - n + 1 + i]) * _MIX
        h ^= h >> np.uint32(15)
    return (h & np.uint32(buckets - 1)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _batches(texts: list[str | None]):
    """Groups of (rows, codes, starts) of about PIECE codes. A long text comes in several pieces: each holds the codes of
    its n-grams, of which the first ``starts`` places are its own and the rest the next one's."""
    rows, parts, starts, size = [], [], [], 0
    more = max(ORDERS) - 1
    for k, t in enumerate(texts):
        if not has_letter(t):
            continue
        c = _codes(t)
        for i in range(0, len(c), PIECE):
            rows.append(k)
            parts.append(c[i : i + PIECE + more])
            starts.append(min(PIECE, len(c) - i))
            size += len(parts[-1])
            if size >= PIECE:
                yield rows, parts, starts
                rows, parts, starts, size = [], [], [], 0
    if rows:
        yield rows, parts, starts


def _grams(parts: list[np.ndarray], starts: list[int], orders: tuple[int, ...], buckets: int):
    """(bucket, part) of each n-gram that begins at a place of its part's own and ends inside it, for each order."""
    a, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    sizes = np.array([len(p) for p in parts])
    first = np.cumsum(sizes) - sizes
    own = np.arange(len(a)) - first[owner] < np.array(starts)[owner]
    for n in orders:
        if len(a) >= n:
            inside = (owner[: len(a) - n + 1] == owner[n - 1 :]) & own[: len(a) - n + 1]
            yield _buckets(a, n, buckets)[inside], owner[: len(inside)][inside]


def count_grams(texts: list[str | None], labels: list[int], n_labels: int, buckets: int, orders=ORDERS) -> np.ndarray:
    """Counts by label and bucket."""
    out = np.zeros((n_labels, buckets), dtype=np.int64)
    labels = np.asarray(labels)
    for rows, parts, starts in _batches(texts):
        lab = labels[np.asarray(rows)]
        for b, own in _grams(parts, starts, orders, buckets):
            out += np.bincount(lab[own] * buckets + b, minlength=n_labels * buckets).reshape(n_labels, buckets)
    return out


def fit(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", fit_rows: int = FIT_ROWS, buckets: int = BUCKETS, alpha: float = 0.5) -> Model:
    """Learn from the rows whose label is not null.

    With more than ``fit_rows`` of them, a share chosen by a hash of id and text is used. Counts are summed on the
    executors; the driver gets a matrix whose size is languages times buckets. No labelled row: a model without languages.
    """
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of {lang_col}: no column of languages")
    counts = {r.lang: r["count"] for r in found}
    langs, total = sorted(counts), sum(counts.values())
    if not langs:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    if total > fit_rows:
        rows = rows.where((F.xxhash64("id", "text") / 2.0**64 + 0.5) < fit_rows / total)
    index = {lang: i for i, lang in enumerate(langs)}

    def count(batches):
        got = np.zeros((len(langs), buckets), dtype=np.int64)
        for b in batches:
            got += count_grams(b.column(1).to_pylist(), [index[x] for x in b.column(0).to_pylist()], len(langs), buckets)
        i, k = np.nonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(got[i, k])], names=["lang", "bucket", "n"])

    summed = rows.select("lang", "text").mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    c = np.full((len(langs), buckets), alpha)
    c[summed["lang"].to_numpy(), summed["bucket"].to_numpy()] += summed["n"].to_numpy()
    logp = np.log(c / c.sum(axis=1, keepdims=True))
    prior = np.array([counts[x] for x in langs], dtype=float)
    return Model(langs, np.ascontiguousarray(logp.T.astype(np.float32)), np.log(prior / prior.sum()))


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Best language of each text and its share of the posterior, tempered by the number of n-grams.

    Naive Bayes takes n-grams for independent and is far too sure of itself; the log-likelihoods are divided by the
    square root of the number of n-grams before they are normalised. Ties go to the first language by name.
    """
    m = len(model.langs)
    total, grams = np.zeros((len(texts), m)), np.zeros(len(texts))
    seen = np.zeros(len(texts), dtype=bool)
    if m:
        for rows, parts, begins in _batches(texts):
            rows = np.asarray(rows)
            seen[rows] = True
            for b, own in _grams(parts, begins, model.orders, model.buckets):
                if not len(b):
                    continue
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                np.add.at(total, rows[own[starts]], np.add.reduceat(model.logp[b], starts, axis=0, dtype=np.float64))
                np.add.at(grams, rows[own[starts]], np.diff(np.r_[starts, len(b)]))
    s = (total + model.prior) / np.sqrt(np.maximum(grams, 1))[:, None] if m else total
    if not m:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, seen)], np.where(seen, p.max(axis=1), 0.0)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score, one row per row, repeated rows too.

    Null texts and texts without a letter get ``und`` and score 0, as does everything if no language was learned. Texts
    of any length are scored whole; of languages that tie the first by name is given. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, p = score(held.value, b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(p, pa.float64())], names=[*names, "lang_pred", "score"])

    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("text"))
    names = [f"c{i}" for i in range(len(keep))]
    shape = ", ".join(f"`c{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = rows.toDF(*names, "text").mapInArrow(run, f"{shape}, lang_pred string, score double")
    return out.toDF(*keep, "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo three, is one. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out()))


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose language cannot be told: no letters, or no language reaches ``least``.

    If nothing is labelled there is nothing to learn from and every document stays. Null and empty texts go; repeated
    rows stay or go together; an empty table stays empty; columns keep their places, whatever their names. Rows pass
    through whole and are only filtered, so each text crosses to Python once.
    """
    model = learn(docs)
    if not model.langs:
        return docs
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, ROWS):  # small pieces back too: the JVM holds each one off its heap
                part = b.slice(i, ROWS)
                lang, p = score(held.value, part.column(place).to_pylist())
                yield part.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, p.tolist())], pa.bool_()))

    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return inner.mapInArrow(run, inner.schema).toDF(*docs.columns)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
