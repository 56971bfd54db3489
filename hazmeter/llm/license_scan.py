"""Licence scans: a trained paragraph classifier, scored with DataFrame operations only.

The model is a softmax regression over word n-grams, trained on the driver from notices and headers of sixteen families
and from paragraphs that grant nothing (constants, so every run learns the same). Features are the runs of one to three
words of the notices that hold a word which is not common; of these, the ones of greatest weight are kept. A paragraph
without any of them has the bias alone, which says unknown: so a search for the features' words, made from the model,
tells which paragraphs need to be scored, and changes no result.

Probabilities are calibrated by one temperature on variants and on whole families that the model was not shown; a
family is named from the probability that keeps 95 % of those foreign to it out (:func:`calibrate`). A comparison with
the family's own notices then has to confirm it.

Paragraphs end at blank lines; wrapped lines are joined. As a notice often stands on a line of its own within other
text, the lines of a paragraph are candidates too.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .licences import COMMON, FOREIGN, TEMPLATES

CLASSES = ("unknown", *TEMPLATES)
#: Share of a notice's pairs of neighbouring words, or of as many as the paragraph has, that the paragraph must hold.
CONFIRM = 0.5
#: n-grams kept, and slots of the table that tells which n-grams may be among them.
FEATURES, SLOTS = 600, 1 << 15
#: What :func:`calibrate` finds; a test holds them to it.
HEAT, THRESHOLD = 0.707, 0.564

_WORD = re.compile(r"[a-z0-9]+")


def grams(text: str) -> set[str]:
    """The runs of one to three words that hold a word which is not common."""
    w = _WORD.findall(text.lower())
    runs = (w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1))
    return {" ".join(r) for r in runs if any(map(_telling, r))}


def _telling(word: str) -> bool:
    return word not in COMMON and not word.isdigit()


def _variants(rng: random.Random, text: str, n: int) -> list[str]:
    """The text, and copies that lack words or stand among others."""
    out = [text]
    w = text.split()
    fill = [x for t in FOREIGN for x in t.split()]
    for _ in range(n - 1):
        kept = [x for x in w if rng.random() > 0.12] or w
        out.append(" ".join([*rng.choices(fill, k=rng.randrange(4)), *kept, *rng.choices(fill, k=rng.randrange(4))]))
    return out


def _rows(rng: random.Random, n: int, without: str | None = None) -> list[tuple[set[str], int]]:
    rows = [(grams(v), CLASSES.index(c)) for c, texts in TEMPLATES.items() if c != without for t in texts for v in _variants(rng, t, n)]
    return rows + [(grams(v), 0) for t in FOREIGN for v in _variants(rng, t, n)]


def _matrix(rows, index: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(rows), len(index) + 1), dtype=np.float32)
    x[:, -1] = 1
    for r, (g, *_) in enumerate(rows):
        found = [index[v] for v in g if v in index]
        x[r, found] = 1 / max(1.0, len(found) ** 0.5)  # long notices weigh no more than short ones
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(without: str | None = None, rounds: int = 250) -> tuple[list[str], np.ndarray]:
    """(n-grams, weights with the biases last), learned without one family if asked so; no temperature applied."""
    rows = _rows(random.Random(7), 12, without)
    own = set().union(*(grams(t) for c, texts in TEMPLATES.items() if c != without for t in texts))
    share: dict[str, np.ndarray] = {g: np.zeros(len(CLASSES)) for g in own}
    for g, c in rows:
        for v in own & g:
            share[v][c] += 1
    sizes = np.maximum(np.bincount([c for _, c in rows], minlength=len(CLASSES)), 1)
    # kept are those whose share in one class stands out most from their share in the next
    apart = {g: -float(np.subtract(*np.sort(n / sizes)[[-1, -2]])) for g, n in share.items()}
    names = sorted(sorted(own, key=lambda g: (apart[g], g))[:FEATURES])
    y = np.eye(len(CLASSES), dtype=np.float32)[[c for _, c in rows]]
    x = _matrix(rows, {g: i for i, g in enumerate(names)})
    w = np.zeros((x.shape[1], len(CLASSES)), dtype=np.float32)
    for _ in range(rounds):
        w += 8.0 * (x.T @ (y - _softmax(x @ w)) / len(x) - 1e-4 * w)
    return names, w


def calibrate() -> tuple[float, float]:
    """(temperature, threshold) from other variants, and from families left out of the learning, which are unknown."""
    logits, y = [], []
    for without in (None, *TEMPLATES):
        names, w = fit(without)
        index = {g: i for i, g in enumerate(names)}
        rng = random.Random(11)
        rows = _rows(rng, 4) if without is None else [(grams(v), 0) for t in TEMPLATES[without] for v in _variants(rng, t, 4)]
        z = _matrix(rows, index) @ w
        logits.append(z)
        y += [c for _, c in rows]
    z, y = np.concatenate(logits), np.array(y)
    heat = min(np.geomspace(0.5, 8, 41), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).sum())
    foreign = _softmax(z / heat)[y == 0][:, 1:].max(axis=1)
    return round(float(heat), 3), round(max(0.5, float(np.quantile(foreign, 0.95))), 3)


@lru_cache(maxsize=1)
def model() -> tuple[dict[str, list[float]], list[float], float]:
    """(weights of each n-gram by class, biases, threshold), the temperature applied."""
    names, w = fit()
    w = w / HEAT
    return {g: [round(float(v), 5) for v in w[i]] for i, g in enumerate(names)}, [round(float(v), 5) for v in w[-1]], THRESHOLD


def probabilities(text: str) -> np.ndarray:
    """The classes' probabilities of one paragraph, by numpy: what the columns below must give."""
    weights, bias, _ = model()
    found = [weights[g] for g in grams(text) if g in weights]
    z = np.array(bias) + (np.sum(found, axis=0) / max(1.0, len(found) ** 0.5) if found else 0)
    return _softmax(z[None, :])[0]


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _slots(texts) -> Column:
    """A table of hashes that tells which texts may be among these."""
    marks = [False] * SLOTS
    for t in texts:
        marks[xxhash.xxh64_intdigest(t.encode(), 42) % SLOTS] = True
    return F.from_json(F.lit(json.dumps(marks)), "array<boolean>")


def _marked(slots: Column, text: Column) -> Column:
    return text.isNotNull() & F.get(slots, F.xxhash64(text).bitwiseAND(F.lit(SLOTS - 1).cast("long")).cast("int"))


def _classify(paragraph: Column) -> Column:
    """(family, probability, overlap, confirmed) of one paragraph."""
    weights, bias, threshold = model()
    table = F.from_json(F.lit(json.dumps(weights)), "map<string,array<double>>")
    slots = _slots(weights)
    pairs = [[sorted({f"{a} {b}" for a, b in zip(w, w[1:])}) for w in (_WORD.findall(t.lower()) for t in texts)] for texts in TEMPLATES.values()]
    pair_slots = _slots({p for texts in pairs for t in texts for p in t})
    templates = F.from_json(F.lit(json.dumps(pairs)), "array<array<array<string>>>")
    zero = F.struct(F.array_repeat(F.lit(0.0), len(bias)).alias("z"), F.lit(0.0).alias("n"))

    def scored(w: Column) -> Column:
        two = F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
        three = F.zip_with(two, F.slice(w, 3, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
        # a map is searched from end to end, so few n-grams are looked up: those whose hash is that of a feature
        few = F.filter(F.concat(w, two, three), lambda g: _marked(slots, g))
        hits = F.filter(F.transform(F.array_distinct(few), lambda g: F.try_element_at(table, g)), lambda x: x.isNotNull())
        summed = F.aggregate(hits, zero, lambda acc, x: F.struct(F.zip_with(acc["z"], x, lambda a, b: a + b).alias("z"), (acc["n"] + 1).alias("n")))
        z = _let(summed, lambda s: F.zip_with(s["z"], _array(bias), lambda a, b: a / F.greatest(F.lit(1.0), F.sqrt(s["n"])) + b))
        return _let(z, lambda z: _let(F.transform(z, lambda v: F.exp(v - F.array_max(z))), lambda e: named(w, e)))

    def named(w: Column, e: Column) -> Column:
        p = _let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda s: F.transform(e, lambda v: v / s))
        best = lambda p: _let(F.array_position(p, F.array_max(p)).cast("int") - 1, lambda k: result(w, k, F.array_max(p)))
        return _let(p, best)

    def result(w: Column, k: Column, top: Column) -> Column:
        known = (k > 0) & (top >= threshold)
        mine = F.array_distinct(F.filter(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: _marked(pair_slots, g)))
        own = _let(mine, lambda m: F.array_max(F.transform(F.get(templates, k - 1), lambda t: F.size(F.array_intersect(m, t)) / F.least(F.greatest(F.size(w) - 1, F.lit(1)), F.size(t)))))
        overlap = F.when(known, F.coalesce(own, F.lit(0.0))).otherwise(0.0)
        family = F.when(known, F.get(_array(CLASSES), k)).otherwise("unknown")
        return F.struct(family.alias("family"), F.round(top, 4).alias("probability"), F.round(overlap, 4).alias("overlap"), (known & (overlap >= CONFIRM)).alias("confirmed"))

    words = F.filter(F.split(paragraph, "[^a-z0-9]+"), lambda x: x != "")
    return _let(words, scored)


@lru_cache(maxsize=1)
def gate() -> tuple[str, ...]:
    """A word of each feature: of its words the one that is in most features, so that few suffice."""
    left, out = {g: [w for w in g.split() if _telling(w)] for g in model()[0]}, []
    while left:
        count: dict[str, int] = {}
        for words in left.values():
            for w in set(words):
                count[w] = count.get(w, 0) + 1
        best = max(sorted(count), key=count.get)
        out.append(best)
        left = {g: words for g, words in left.items() if best not in words}
    return tuple(sorted(out))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, found): one row per row of ``docs``, repeated rows too.

    Paragraphs of the whole text end at blank lines. ``found`` lists paragraphs, and lines of paragraphs of several
    lines, that hold a feature's word: place of the paragraph from 0, of the line in it from 0 or -1 for the whole,
    family (or unknown), probability, overlap with the nearest notice and whether that confirms the family. Null and
    empty texts have no paragraph, an empty table gives no rows; other columns are ignored, whatever their names.
    """
    words = F.from_json(F.lit(json.dumps(gate())), "array<string>")
    holds = lambda t: F.arrays_overlap(F.split(t, "[^a-z0-9]+"), words)
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text = F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    parts = F.filter(F.split("text", r"\n[ \t]*(?=\n)"), lambda p: p.rlike(r"[^ \t\n]"))
    rows = rows.select("doc_id", parts.alias("parts"), holds(F.col("text")).alias("some"))
    lines = lambda p: F.filter(F.split(p, "\n"), lambda x: x.rlike(r"[^ \t]"))

    def candidates(p: Column, i: Column) -> Column:
        whole = F.struct(i.alias("paragraph"), F.lit(-1).alias("line"), F.replace(p, F.lit("\n"), F.lit(" ")).alias("text"))
        each = lambda ls: F.transform(ls, lambda x, k: F.struct(i.alias("paragraph"), k.alias("line"), x.alias("text")))
        return _let(lines(p), lambda ls: F.when(F.size(ls) > 1, F.concat(F.array(whole), each(ls))).otherwise(F.array(whole)))

    hits = F.filter(F.flatten(F.transform(F.filter(F.transform("parts", lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda s: holds(s["p"])), lambda s: candidates(s["p"], s["i"]))), lambda s: holds(s["text"]))
    kept = rows.select("doc_id", F.size("parts").cast("long").alias("n_paragraphs"), F.when(F.col("some"), hits).otherwise(F.array()).alias("hits"))
    found = F.transform("hits", lambda s: F.struct(s["paragraph"].alias("paragraph"), s["line"].alias("line"), _classify(s["text"]).alias("c")))
    return kept.select("doc_id", "n_paragraphs", found.alias("found"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed lines, and confirmed paragraphs that no line of theirs explains."""
    f = scan(documents(spark, sf_dir))
    sure = F.filter("found", lambda s: s["c"]["confirmed"])
    f = f.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_candidates"), sure.alias("sure"))
    alone = lambda s: (s["line"] >= 0) | ~F.exists("sure", lambda o: (o["paragraph"] == s["paragraph"]) & (o["line"] >= 0) & (o["c"]["family"] == s["c"]["family"]))
    f = f.withColumn("sure", F.filter("sure", alone))
    spans = F.array_join(F.transform("sure", lambda s: F.concat_ws(":", s["c"]["family"], s["paragraph"], s["line"])), ",")
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("sure", lambda s: s["c"]["family"]))), ",")
    return f.select("doc_id", "n_paragraphs", "n_candidates", F.size("sure").cast("long").alias("n_confirmed"), families.alias("families"), spans.alias("spans"))
