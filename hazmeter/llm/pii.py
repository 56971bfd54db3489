r"""Personal data by patterns and a skip-chain conditional random field.

Patterns find what is written in full. The field is for the rest: a number given once as ``+1 (555) 555-0100`` and
later as ``555-0100``, an address cut short. Its nodes are the numbers and addresses of a document, each as a whole
however its groups are parted; all other text is known to be outside, so the chain falls into short islands. Neighbours
share transition potentials; equal or similar nodes, however far apart (the digits of one end those of the other, an
address begins as another does), share a potential of their own (the skip edges).

All potentials are trained together, by the pseudo-likelihood of each label given its neighbours', on a bounded sample.
Labels there come from the patterns, and what a skip edge ties to a match of theirs has its label; matches are repeated
in other spellings, beside other numbers in the same ones. Loopy message passing
then gives each node's marginal in every document that has a node, matches of the patterns being observed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

KINDS = ("email", "ip", "card", "phone")
#: Documents with candidates that the field is trained on, at most about.
FIT_DOCS = 3_000
#: Marginal from which a node counts as personal data: nodes tied to a match lie above, others of the same look far below.
SURE = 0.6

# Fixed by the contract of the operator. Runs are taken without giving back, which changes no match and keeps time linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_SIGN = re.compile(r"@[A-Za-z0-9.-]*")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*")
_GROUP = re.compile(r"[0-9]+")
#: Characters between neighbours of the chain, at most.
NEAR = 12
_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, sorted."""
    if not text or not _ANY.search(text):
        return []
    out = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            at = begin = m.start()
            while begin > free and text[begin - 1] in _LOCALS:
                begin -= 1
            if begin < at:
                out.append((begin, 0, m.end()))
                free = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass(frozen=True)
class Field:
    """Potentials as logarithms; label 0 is outside, label k + 1 is kind k."""

    node: np.ndarray  # features x labels
    step: np.ndarray  # labels x labels
    skip: np.ndarray  # labels x labels


def _features(tok: str) -> list[float]:
    d = _digits(tok)
    n, groups = len(d), len(_GROUP.findall(tok))
    return [
        1.0, "@" in tok, "@" in tok and "." in tok.rpartition("@")[2], tok.count(".") == 3, "." in tok, "-" in tok, " " in tok, tok[:1] == "+", "(" in tok,
        any(c.isalpha() for c in tok), n == len(tok), n <= 2, 3 <= n <= 4, 5 <= n <= 6, n == 7, 8 <= n <= 9, n == 10, n == 11, 12 <= n <= 15, 16 <= n <= 19, n > 19,
        12 <= n <= 19 and luhn(d), groups == 1, groups == 2, groups == 3, groups >= 4,
    ]


def _tied(a: str, b: str) -> bool:
    """Whether two nodes of one key are equal or similar."""
    if "@" in a:
        x, y = (t.lower().rstrip(".") for t in (a, b))
        return x.startswith(y) or y.startswith(x)
    x, y = _digits(a), _digits(b)
    return x.endswith(y) or y.endswith(x)


def _key(tok: str) -> str | None:
    """What similar nodes share: the part of an address before the sign, the last seven digits, a whole dotted number."""
    if "@" in tok:
        return tok.partition("@")[0].lower() + "@"
    if tok.count(".") > 1:
        return tok
    d = _digits(tok)
    return d[-7:] if len(d) >= 7 else None


def _nodes(text: str, base: list[tuple[int, int, int]]):
    """Nodes (start, end), their labels by the patterns, neighbour pairs and skip pairs."""
    spans = []
    if "@" in text:
        free = 0
        for m in _SIGN.finditer(text):
            begin = m.start()
            while begin > free and text[begin - 1] in _LOCALS:
                begin -= 1
            if begin < m.start():
                spans.append((begin, m.end()))
                free = m.end()
    taken, k = spans, 0
    numbers = []
    for m in _NUMBER.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            numbers.append(m.span())
    toks = sorted([*spans, *numbers])
    labels, k = [0] * len(toks), 0
    for i, (a, b) in enumerate(toks):
        while k < len(base) and base[k][2] <= a:
            k += 1
        for s in base[k : k + 8]:
            if s[0] < b and a < s[2]:
                labels[i] = s[1] + 1
                break
    near = [(i, i + 1) for i in range(len(toks) - 1) if toks[i + 1][0] - toks[i][1] <= NEAR]
    # each is tied to the one of its key before it, which ties all together, and to the last one that a pattern matched
    seen: dict[str, int] = {}
    sure: dict[str, int] = {}
    far = []
    for i, (a, b) in enumerate(toks):
        if key := _key(text[a:b]):
            for j in sorted({seen.get(key, i), sure.get(key, i)} - {i}):
                if _tied(text[slice(*toks[j])], text[a:b]):
                    far.append((j, i))
            seen[key] = i
            if labels[i]:
                sure[key] = i
    return toks, labels, near, far


def _spread(labels: list[int], far: list[tuple[int, int]]) -> list[int]:
    """Labels with those that skip edges hand on."""
    out = list(labels)
    for i, j in (*far, *reversed(far)):
        out[i], out[j] = out[i] or out[j], out[j] or out[i]
    return out


def _worn(match: str, kind: int) -> list[str]:
    """Other spellings under which a match may come again."""
    d = _digits(match)
    if kind == 0:
        local, _, domain = match.partition("@")
        return [f"{local}@{domain.rpartition('.')[0]}" if domain.count(".") > 1 else f"{local}@{domain.partition('.')[0]}"]
    if kind == 2:
        return [d, " ".join(d[i : i + 4] for i in range(0, len(d), 4))]
    return [f"{d[-7:-4]}-{d[-4:]}", f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", d[-10:], f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", d] if kind == 3 else []


def _lesson(text: str, most: int = 3) -> str:
    """A text to learn from: behind it, matches of its own in other spellings, and the same spellings of other numbers,
    so that not the look of a number decides but what it is tied to."""
    turned = str.maketrans("0123456789abcdefghijklmnopqrstuvwxyz", "3456789012bcdefghijklmnopqrstuvwxyza")
    more = [w for a, k, b in base_spans(text)[:most] for w in _worn(text[a:b], k)]
    return " ; ".join([text, *(x for w in more for x in (f"again {w}", f"but other words {w.partition('@')[0].lower().translate(turned)}{''.join(w.partition('@')[1:])}"))])


def train(texts: list[str], rounds: int = 800, ridge: float = 3e-2) -> Field | None:
    """Potentials by the greatest pseudo-likelihood, all at once; None if the patterns find nothing to learn from."""
    x, y, near, far = [], [], [], []
    for t in map(_lesson, texts):
        toks, labels, n, f = _nodes(t, base_spans(t))
        at = len(y)
        x += [_features(t[a:b]) for a, b in toks]
        y += _spread(labels, f)
        near += [(i + at, j + at) for i, j in n]
        far += [(i + at, j + at) for i, j in f]
    if not any(y):
        return None
    x, y = np.array(x, dtype=float), np.array(y)
    near, far = (np.array(e, dtype=int).reshape(-1, 2) for e in (near, far))
    hot = np.eye(5)[y]
    parts = [np.zeros((x.shape[1], 5)), np.zeros((5, 5)), np.zeros((5, 5))]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for r in range(1, rounds + 1):
        w, step, skip = parts
        z = x @ w
        np.add.at(z, near[:, 0], step[:, y[near[:, 1]]].T)
        np.add.at(z, near[:, 1], step[y[near[:, 0]], :])
        both = skip + skip.T
        np.add.at(z, far[:, 0], both[:, y[far[:, 1]]].T)
        np.add.at(z, far[:, 1], both[y[far[:, 0]], :])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        off = hot - p / p.sum(axis=1, keepdims=True)
        turn = off[far[:, 0]].T @ hot[far[:, 1]] + off[far[:, 1]].T @ hot[far[:, 0]]
        grads = [x.T @ off - ridge * w, off[near[:, 0]].T @ hot[near[:, 1]] + hot[near[:, 0]].T @ off[near[:, 1]] - ridge * step, turn + turn.T - ridge * skip]
        for k, g in enumerate(grads):  # steps of even length, as some potentials are met far more often than others
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            parts[k] = parts[k] + 0.3 * (1 - r / (rounds + 1)) * (mean[k] / (1 - 0.9**r)) / (np.sqrt(square[k] / (1 - 0.99**r)) + 1e-8)
    return Field(parts[0], parts[1], parts[2] + parts[2].T)


def marginals(field: Field, feats: np.ndarray, labels: list[int], near, far, rounds: int = 24) -> np.ndarray:
    """Labels' shares of each node after loopy message passing. Nodes that the patterns labelled are observed."""
    unary = feats @ field.node
    seen = np.flatnonzero(labels)
    unary[seen] = -60.0
    unary[seen, np.asarray(labels)[seen]] = 0.0
    edges = np.array([*near, *far], dtype=int).reshape(-1, 2)
    if len(edges):
        pot = np.stack([field.step] * len(near) + [field.skip] * len(far))
        src, dst = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
        msg = np.zeros((len(src), 5))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            z = (belief[src] - msg[back])[:, :, None] + pot
            top = z.max(axis=1)
            new = top + np.log(np.exp(z - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            done = np.abs(new - msg).max() < 1e-9
            msg = 0.5 * msg + 0.5 * new
            if done:
                break
        np.add.at(unary, dst, msg)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def extra_spans(field: Field | None, text: str | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the field adds: nodes of whose label it is sure and that no pattern matched, in any document."""
    if field is None or not text or not _ANY.search(text):
        return []
    toks, labels, near, far = _nodes(text, base)
    if not toks or all(labels):
        return []
    p = marginals(field, np.array([_features(text[a:b]) for a, b in toks], dtype=float), labels, near, far)
    out = []
    for i in np.flatnonzero(p[:, 0] <= 1 - SURE).tolist():
        k = int(p[i].argmax())
        if labels[i] == 0 and k and p[i, k] >= SURE:
            a, b = toks[i]
            out.append((a, k - 1, a + len(text[a:b].rstrip(".-"))))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, chars: int = 20_000) -> Field | None:
    """Train on at most about ``fit_docs`` documents of up to ``chars`` characters, chosen by a hash of id and text."""
    rows = docs.where(F.col(text_col).rlike("[0-9@]") & (F.length(text_col) <= chars)).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.count()
    if total > fit_docs:
        rows = rows.where((F.xxhash64("id", "text") / 2.0**64 + 0.5) < fit_docs / total)
    return train([r.text for r in rows.select("text").limit(2 * fit_docs).collect()])


def find(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, extra): arrays of (start, kind, end), one row per row of ``docs``, repeated rows too.

    Null text counts as empty; texts of any length are read whole; without a field there is no extra span. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    pair = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            base, extra = [], []
            for t in b.column(1).to_pylist():
                found = base_spans(t)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                extra.append([{"start": s, "kind": k, "end": e} for s, k, e in extra_spans(held.value, t, found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pair), pa.array(extra, pair)], names=["doc_id", "base", "extra"])

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"doc_id {kind}, base array<struct<start:bigint,kind:int,end:bigint>>, extra array<struct<start:bigint,kind:int,end:bigint>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, shape)


def joined(spans) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = find(docs, fit(docs))
    # the kind must not be a second parameter of the inner function, which Spark fills with a span's place
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias("n_" + KINDS[kind])
    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "extra"))).alias("spans"))
