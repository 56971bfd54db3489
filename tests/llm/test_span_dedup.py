"""Runs of sentences and stretches of words against a version of their own that shares no code with the operator."""

import collections
import random
import re

import numpy as np
import xxhash

from hazmeter.llm import common, span_dedup

from .conftest import table

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def fold(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def words_of(text):
    return [(m.start(), m.end(), m[0]) for m in re.finditer(f"[^{BLANKS}]+", text)]


def sentences_of(text):
    words, out, begin = words_of(text), [], 0
    for k, (_, end, w) in enumerate(words):
        final = k + 1 == len(words)
        mark = w[-1] in ".!?" or len(w) > 1 and w[-1] in "\"')]}" and w[-2] in ".!?" or not final and "\n" in text[end : words[k + 1][0]]
        if final or mark and k + 1 - begin >= 4:
            out.append((begin, k))
            begin = k + 1
    return words, out


def runs_of(text):
    words, sents = sentences_of(text)
    for i in range(len(sents) - 2):
        a, b = sents[i][0], sents[i + 2][1]
        yield words[a][0], words[b][1], tuple(fold(w) for _, _, w in words[a : b + 1])


def removed_of(docs):
    """The places that go by runs of sentences alone."""
    seen, gone = set(), collections.defaultdict(set)
    for i in sorted(docs):
        for a, b, key in runs_of(docs[i] or ""):
            if key in seen:
                gone[i].update(range(a, b))
            seen.add(key)
    return gone


def longer_runs(docs):
    """The places that go if every run of three or more sentences counts."""
    seen, gone = set(), collections.defaultdict(set)
    for i in sorted(docs):
        words, sents = sentences_of(docs[i] or "")
        for x in range(len(sents)):
            for y in range(x + 2, min(len(sents), x + 12)):
                a, b = sents[x][0], sents[y][1]
                key = tuple(fold(w) for _, _, w in words[a : b + 1])
                if key in seen:
                    gone[i].update(range(words[a][0], words[b][1]))
                seen.add(key)
    return gone


def stretches_of(text):
    """Stretches chosen by the operator's own choice of places, hashed and cut by this file."""
    raw = text.encode()
    a = np.frombuffer(raw, dtype=np.uint8)
    start, end, doc = span_dedup.words(a, np.array([0, len(a)]))
    for k in span_dedup._stretches(a, start, end, doc).tolist():
        x, y = len(raw[: start[k]].decode()), len(raw[: end[k + 23]].decode())
        yield x, y, tuple(fold(w) for w in re.split(f"[{BLANKS}]+", text[x:y]))


def test_brute_force(spark):
    docs = {r.doc_id: r.text for r in common.documents(spark, SF).collect()}
    docs |= {90_000: "Buy cheap pills right now. Click on this link today. Only for a few days.", 90_001: "Other words stand here. buy CHEAP pills\tright  now. Click on this link today.  Only for a few days. More of it."}
    got = {r.doc_id: r for r in span_dedup.remove_repeats(table(spark, docs.items())).collect()}
    gone, seen = removed_of(docs), set()
    assert {i: s for i, s in gone.items() if s} == {i: s for i, s in longer_runs(docs).items() if s}
    for i in sorted(docs):
        for a, b, key in stretches_of(docs[i]):
            if key in seen:
                gone[i].update(range(a, b))
            seen.add(key)
    assert sum(map(bool, gone.values())) > 20
    for i, text in docs.items():
        covered = set()
        for s in got[i].removed:
            covered.update(range(s.start, s.end))
        assert {p for p in covered if text[p] not in BLANKS} == {p for p in gone[i] if text[p] not in BLANKS}, i
        assert got[i].clean_text.split() == "".join(" " if p in covered else c for p, c in enumerate(text)).split()
        assert got[i].n_removed == sum(s.end - s.start for s in got[i].removed)
    assert got[90_000].n_removed == 0 and got[90_001].clean_text == "Other words stand here. More of it."


def test_any_fifty_words():
    rng = random.Random(5)
    for mark in (0, 0.05, 0.15, 0.5):
        word = lambda: f"w{rng.randrange(10**6)}" + ("." if rng.random() < mark else "")
        for _ in range(300):
            passage = [word() for _ in range(50)]
            digests = []
            for _ in range(2):
                text = " ".join([*(word() for _ in range(rng.randrange(80))), "edge", *passage, "edge", *(word() for _ in range(rng.randrange(80)))])
                a = np.frombuffer(text.encode(), dtype=np.uint8)
                digests.append(set(zip(*(x.tolist() for x in span_dedup.spans(a, np.array([0, len(a)]))[1:3]))))
            assert digests[0] & digests[1]


def test_batches_do_not_matter():
    """A document's runs are the same alone and among others."""
    rng = random.Random(6)
    texts = ["", "a", " ", *(" ".join(rng.choice("the of and. to\nin that. it Was".split(" ")) + str(rng.randrange(9)) for _ in range(rng.randrange(200))) for _ in range(60))]
    raw = [t.encode() for t in texts]
    edges = np.r_[0, np.cumsum([len(x) for x in raw])]
    doc, high, low, x, y = span_dedup.spans(np.frombuffer(b"".join(raw), dtype=np.uint8), edges)
    for k, r in enumerate(raw):
        _, h, g, a, b = span_dedup.spans(np.frombuffer(r, dtype=np.uint8), np.array([0, len(r)]))
        on = doc == k
        assert sorted(zip(h, g, a, b)) == sorted(zip(high[on], low[on], x[on] - edges[k], y[on] - edges[k]))
        for hh, gg, p, q in zip(h.tolist(), g.tolist(), a.tolist(), b.tolist()):
            d = xxhash.xxh3_128_digest(" ".join(re.split(f"[{BLANKS}]+", "".join(map(fold, r[p:q].decode())))).encode())
            assert d == hh.to_bytes(8, "big", signed=True) + gg.to_bytes(8, "big", signed=True)


def test_odd_tables(spark, odd, empty):
    rows, df = odd
    out = span_dedup.remove_repeats(df).collect()
    assert len(out) == len(rows) and all(r.clean_text == "" for r in out if r.doc_id in (1, 2))
    assert {r.doc_id: r.n_removed > 0 for r in out if r.doc_id in (8, 9)} == {8: False, 9: True}
    assert sorted(r.clean_text for r in out if r.doc_id == 7) == sorted(t for i, t in rows if i == 7)
    assert span_dedup.remove_repeats(empty).count() == 0
    wide = table(spark, [(1, "Eins zwei drei vier fünf. É a b c d e. Öl ist hier für dich."), (2, "𝔘 x. Eins zwei drei vier fünf.  É a b c d e.\nÖl ist hier für dich. ß Ende.")])
    got = {r.doc_id: r for r in span_dedup.remove_repeats(wide).collect()}
    assert got[2].clean_text == "𝔘 x. ß Ende." or got[2].n_removed == 0
    assert [(s.start, s.end) for s in got[2].removed] in ([], [(5, 64)])
