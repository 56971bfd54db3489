r"""Secret scans by a battery of randomness tests, with DataFrame operations only.

Three patterns give the base spans. Beyond them, every run of 20 or more characters of common encodings is a
candidate. Its encoding (hexadecimal, base32, alphanumeric, base64) is inferred from its characters, and it has to
look like a uniform draw from that alphabet: a chi-squared test of the symbol counts (in as many equal cells as leave
five expected in each), a runs test of the upper and lower half of the alphabet and a test of the serial correlation,
joined by Bonferroni's rule.

Most candidates are ordinary: words, names, numbers. How unlikely one is among these is the battery's chi-squared
test from the other side, in its likelihood form: the counts of eight kinds of symbols against their shares in prose,
in capitals, and in numbers. The least of the three divergences counts, and the method of types turns n characters'
divergence D into a p-value that holds at any length, C(n + 7, 7) exp(-n D); no normal tail is trusted at 20
characters. Over all documents, Benjamini and Hochberg's rule is applied to these p-values within each class of
lengths, so that the many short candidates do not pay for the few long ones nor hide behind them.

Where a match begins is found without Python: ``split`` gives what lies between the matches, ``regexp_extract_all``
the matches, and their lengths add up to code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stage

# Fixed by the contract of the operator, quoted for Java's regular expressions.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Level of the joint randomness test, and of the false-discovery control.
ALPHA, FDR = 0.001, 0.01
#: Lower bounds of the classes of lengths.
CLASSES = (20, 28, 40, 64, 128)
#: p-values count to this power of ten, in steps of a quarter.
FINEST = 100

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = {"hex": DIGITS + "abcdef", "base32": UPPER + "234567", "alnum": DIGITS + LOWER + UPPER, "base64": DIGITS + LOWER + UPPER + "+/"}
#: Kinds of symbols: vowels, frequent and rare consonants in lower and in upper case, digits, signs.
KINDS = ("aeiou", "tnshrdl", "bcfgjkmpqvwxyz", "AEIOU", "TNSHRDL", "BCFGJKMPQVWXYZ", DIGITS, "+/_-")
#: Shares of the kinds in ordinary text, in per mille: prose with few capitals, capitals, numbers, all with some signs.
ORDINARY = ((360, 380, 180, 20, 20, 15, 15, 10), (15, 15, 15, 360, 380, 180, 20, 15), (25, 25, 25, 25, 25, 25, 800, 50))
#: Expected symbols in a cell of the chi-squared test, at least.
EXPECTED = 5


def _find(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end) of the matches whose group has ``least`` or more characters, empty where there is none."""
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gap = F.split(text, pattern, -1)
    zipped = F.zip_with(F.zip_with(F.slice(gap, 1, F.size(hit)), hit, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h"))), value, lambda p, v: F.struct(p["g"].alias("g"), p["h"].alias("h"), F.length(v).alias("v")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, x):
        start = acc["at"] + x["g"]
        span = F.struct(start.alias("start"), (start + x["h"]).alias("end"))
        return F.struct((start + x["h"]).alias("at"), F.when(x["v"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(zipped, zero, step, lambda acc: acc["out"])).otherwise(empty)


def _tail(z: Column) -> Column:
    """Share of the normal distribution above z, by a logistic approximation good to about 1e-4."""
    return 1 / (1 + F.exp(F.least(F.lit(300.0), 1.5976 * z + 0.07056 * z * z * z)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _battery(token: Column) -> Column:
    """(p_random, log10_p): the battery's joint p-value, and the bound on the p-value as ordinary text."""
    random = _let(F.translate(token, "-_", "+/"), _of_token)
    return F.struct(random.alias("p_random"), _ordinary(token).alias("log10_p"))


def _of_token(t: Column) -> Column:
    hexa, upper, b32, alnum = t.rlike("^[0-9a-f]+$"), t.rlike("^[0-9A-F]+$"), t.rlike("^[A-Z2-7]+$"), t.rlike("^[0-9A-Za-z]+$")
    h, b, a, o = (F.lit(x) for x in ENCODINGS.values())
    return _let(F.when(hexa, h).when(upper, F.lit(ENCODINGS["hex"].upper())).when(b32, b).when(alnum, a).otherwise(o), lambda alphabet: _in_alphabet(t, alphabet))


def _in_alphabet(t: Column, alphabet: Column) -> Column:
    k, n = F.length(alphabet).cast("double"), F.length(t).cast("double")
    codes = F.transform(F.split(t, ""), lambda c: F.instr(alphabet, c) - F.lit(1.0))
    # equal cells of neighbouring symbols; where the alphabet does not divide evenly, shares differ and are told apart
    cells = F.greatest(F.lit(2.0), F.least(k, F.floor(n / EXPECTED)))
    counts = F.transform(F.sequence(F.lit(1), cells.cast("int")), lambda c: _let(F.substring(alphabet, (F.ceil((c - 1) * k / cells) + 1).cast("int"), (F.ceil(c * k / cells) - F.ceil((c - 1) * k / cells)).cast("int")), lambda own: F.struct(F.length(F.regexp_replace(t, F.concat(F.lit("[^"), own, F.lit("]")), F.lit(""))).cast("double").alias("o"), (n * F.length(own) / k).alias("e"))))
    chi = F.aggregate(counts, F.lit(0.0), lambda a, x: a + (x["o"] - x["e"]) * (x["o"] - x["e"]) / x["e"])
    df = cells - 1
    p1 = _tail((F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("high", "runs", "serial")], F.lit(-1.0).alias("last"))

    def step(s, x):
        first = s["last"] < 0
        up = F.when(x >= k / 2, 1.0).otherwise(0.0)
        was = F.when(s["last"] >= k / 2, 1.0).otherwise(0.0)
        mid = (k - 1) / 2
        return F.struct(
            (s["high"] + up).alias("high"), (s["runs"] + F.when(first, 1.0).otherwise(F.abs(up - was))).alias("runs"),
            (s["serial"] + F.when(first, 0.0).otherwise((s["last"] - mid) * (x - mid))).alias("serial"), x.alias("last"),
        )

    def tests(s):
        n1, n0 = s["high"], n - s["high"]
        mean = 2 * n0 * n1 / n + 1
        spread = F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (n - 1)))
        # half a run less, as runs are whole numbers
        p2 = F.when((n1 == 0) | (n0 == 0), F.pow(F.lit(2.0), 1 - n)).otherwise(2 * _tail(F.greatest(F.lit(0.0), F.abs(s["runs"] - mean) - 0.5) / spread))
        p3 = 2 * _tail(F.abs(s["serial"]) / ((n - 1) * (k * k - 1) / 12) * F.sqrt(n - 1))
        return F.least(F.lit(1.0), 3 * F.least(p1, p2, p3))

    return F.aggregate(codes, zero, step, tests)


def _ordinary(t: Column) -> Column:
    """log10 of the bound on the p-value of a token's kinds of symbols as ordinary text; 0 is the greatest."""
    n = F.length(t).cast("double")
    counts = F.array(*[(n - F.length(F.translate(t, kind, ""))).cast("double") for kind in KINDS])

    def bound(c):
        def divergence(shares):
            logs = F.array(*[F.lit(math.log10(x / sum(shares))) for x in shares])
            return F.aggregate(F.zip_with(c, logs, lambda o, share: F.when(o > 0, o * (F.log10(o / n) - share)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)

        types = sum((F.log10((n + i) / i) for i in range(1, len(KINDS))), F.lit(0.0))
        return F.least(F.lit(0.0), types - F.least(*map(divergence, ORDINARY)))

    return _let(counts, bound)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, extra): arrays of spans (start, kind, end) with kinds 0 assign, 1 access, 2 hex, 3 random.

    Offsets are code points, the end exclusive. Null text counts as empty and has no span; rows are taken one by
    one, repeated or not, texts of any length whole; other columns are ignored, whatever their names; an empty table
    gives no rows. ``extra`` holds what the battery adds: candidates that pass it, are discoveries at the
    false-discovery rate and overlap no base span.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tag = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    base = F.array_sort(F.concat(tag(_find(text, ASSIGN, 2, 6), 0), tag(_find(text, ACCESS, 0, 20), 1), tag(_find(text, HEX, 0, 24), 2)))
    token = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("token"))
    found = stage(rows.select("doc_id", base.alias("base"), F.transform(_find(text, CANDIDATE, 0, 20), token).alias("c")), "candidates")

    def tested(s):
        rated = lambda b: F.struct(s["start"].alias("start"), s["end"].alias("end"), b["p_random"].alias("p_random"), F.least(F.lit(FINEST * 4), F.floor(-b["log10_p"] * 4)).cast("int").alias("bin"), _class(s["end"] - s["start"]).alias("class"))
        return _let(_battery(s["token"]), rated)

    free = F.filter("c", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    kept = stage(found.select("doc_id", "base", F.transform(free, tested).alias("c")), "secrets")
    # Benjamini and Hochberg over at most classes x bins counts
    bins = {}
    for r in kept.select(F.explode("c").alias("c")).groupBy("c.class", "c.bin").count().collect():
        bins.setdefault(r["class"], {})[r["bin"]] = r["count"]
    least = []
    for k in range(len(CLASSES)):
        counts, seen, cut = bins.get(k, {}), 0, FINEST * 4 + 1
        for b in sorted(counts, reverse=True):
            seen += counts[b]
            if 10 ** (-b / 4) <= FDR * seen / sum(counts.values()):
                cut = b
        least.append(cut)
    needed = F.array(*[F.lit(x) for x in least])
    extra = F.filter("c", lambda t: (t["p_random"] >= ALPHA) & (t["bin"] >= F.get(needed, t["class"])))
    return kept.select("doc_id", "base", F.transform(extra, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"))).alias("extra"))


def _class(n: Column) -> Column:
    out = F.lit(0)
    for k, low in enumerate(CLASSES):
        out = F.when(n >= low, k).otherwise(out)
    return out


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(x) for x in ("assign", "access", "hex", "random")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "extra"))).alias("spans"))
